"""Wire contracts and fixed vocabularies of the factory data model."""

from pyspark.sql import types as T

_S, _D, _L, _I, _TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType(),
)


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Field names and types of the bus contract.
SENSOR = _struct(
    machine_id=_S, timestamp=_S, etat=_S, charge_travail=_D, consommation_electrique=_D,
    vibration=_D, temperature=_D, pression=_D,
)
MEASURES = ["charge_travail", "consommation_electrique", "vibration", "temperature", "pression"]

# Every alias a production order may use. Numbers are read as text, so that a
# wrongly typed field does not void its neighbours.
ORDER = _struct(
    task_id=_S, id=_S, tache_id=_S,
    product_name=_S, produit=_S, product=_S,
    quantity=_S, quantite=_S, qty=_S,
    duration_minutes=_S, duree_minutes=_S, duration=_S,
    priority=_S, timestamp=_S, status=_S,
)
ML_ALERT = _struct(
    machine_id=_S, action=_S, timestamp=_S, temperature=_D, charge_travail=_D, severity=_S,
)
MAINTENANCE_ACTION = _struct(action=_S, machine_id=_S, timestamp=_S, user=_S)
ENERGY_ALERT = _struct(
    machine_id=_S, type_alerte=_S, valeur_actuelle=_D, valeur_normale=_D, timestamp_detection=_S,
)
FAILURE_ALERT = _struct(machine_id=_S, probabilite_panne=_D, timestamp_detection=_S)
MACHINE_COMMAND = _struct(machine_id=_S, action=_S)
ASSIGNMENT = _struct(
    task_id=_S, machine_id=_S, product_name=_S, quantity=_L, duration_minutes=_I, timestamp=_S,
)
MACHINE_STATUS = _struct(machine_id=_S, status=_S, details=_S, timestamp=_S)

# Topic names.
TOPICS = {
    "sensors": "donnees-capteurs",
    "orders": "plan-de-production",
    "ml_alerts": "alertes-ml",
    "failure_alerts": "alertes-pannes",
    "energy_alerts": "alertes-energie",
    "commands": "commandes-machines",
    "maintenance": "actions-maintenance",
    "assignments": "assignations-taches",
    "statuses": "statuts-machines",
    "system_alerts": "alertes-systeme",
}

# Serving measurements and their columns (time columns are added
# by the writer: event_time and ingest_time).
MEASUREMENTS = {
    "etat_machines": ["machine_id", "etat", "charge_travail", "temperature", "vibration",
                      "consommation_electrique"],
    "predictions": ["machine_id", "probabilite_panne"],
    "anomalies_energie": ["machine_id", "type_alerte", "valeur_actuelle", "valeur_normale"],
    "statut_machines": ["machine_id", "statut", "details"],
    "assignations": ["machine_id", "task_id", "product_name", "duration_minutes"],
    "pause_starts": ["machine_id", "pause_start_timestamp", "pause_start_iso"],
    "resource_manager_stats": ["total", "completed", "interrupted", "in_queue",
                               "pauses_expired", "emergency_returns", "repairs"],
    "task_queue": ["size"],
    "interruptions": ["machine_id", "task_id", "progress", "outcome"],
    "rejects": ["raw", "reason"],
    "transitions": ["machine_id", "transition", "seq", "change"],
    "late_events": ["raw", "reason"],
    "rollups": ["machine_id", "measure", "total", "n", "peak"],
}
# Columns of measurements that aren't text.
MEASUREMENT_TYPES = (
    dict.fromkeys([*MEASURES, "probabilite_panne", "valeur_actuelle", "valeur_normale",
                   "pause_start_timestamp", "progress"], _D)
    | dict.fromkeys([*MEASUREMENTS["resource_manager_stats"], "size"], _L)
    | {"duration_minutes": _I, "seq": _L, "change": _I, "total": _D, "n": _L, "peak": _D})

# Vocabularies.
STATUSES = ["DISPONIBLE", "ASSIGNEE", "PAUSE", "ARRET", "IDLE"]
STATUS_LABELS = {"DISPONIBLE": "available", "ASSIGNEE": "running", "PAUSE": "cooldown",
                 "ARRET": "down", "IDLE": "idle"}
ACTIONS = ["CONTINUER", "PAUSE", "ARRETER"]
CLASS_LABELS = ["aucune", "pause_requise", "maintenance_requise"]
MAINTENANCE_ACTIONS = ["REPARER", "FORCER_ARRET"]

FEATURES = [
    "vibration", "temperature", "pression", "consommation_electrique", "charge_travail",
    "vib_mean", "temp_mean", "vib_std", "pres_std", "temp_slope", "vib_slope", "temp_max",
]
