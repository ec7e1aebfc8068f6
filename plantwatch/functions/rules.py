"""Classification rules, alert fields and machine scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plantwatch import schemas
from plantwatch.functions.times import as_column, seconds_between
from plantwatch.functions.values import clamp, percent, real, rounded, zero_if_null
from plantwatch.params import DEFAULTS, Params


def energy_class(power, load, p: Params = DEFAULTS) -> Column:
    power, load = real(power), real(load)
    return (F.when(power > p.power_high, F.lit("surconsommation"))
            .when((power > p.power_leak) & (load < p.load_leak), F.lit("fuite")))


def _severity_levels(temperature, load, p: Params):
    t, c = real(temperature), real(load)
    critical = (t > p.temp_critical) | (c > p.load_critical)
    warning = (t > p.temp_warning) | (c > p.load_warning)
    return critical, warning


def risk_class(temperature, load, p: Params = DEFAULTS) -> Column:
    critical, warning = _severity_levels(temperature, load, p)
    return F.when(critical, 2).when(warning, 1).otherwise(0)


def class_confidence(cls) -> Column:
    # Confidence of the rule per class 0, 1, 2.
    return F.element_at(F.array(*[F.lit(v) for v in (0.99, 0.85, 0.95)]), as_column(cls) + 1)


def rule_failure_probability(temperature, load, p: Params = DEFAULTS) -> Column:
    critical, warning = _severity_levels(temperature, load, p)
    return F.when(critical, 0.95).when(warning, 0.6).otherwise(0.05)


def probability_band(probability) -> Column:
    # Dashboard bands.
    prob = as_column(probability)
    return F.when(prob >= 0.85, "red").when(prob >= 0.6, "orange").otherwise("green")


def _named(names, cls) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), as_column(cls) + 1)


def class_label(cls) -> Column:
    return _named(schemas.CLASS_LABELS, cls)


def class_action(cls) -> Column:
    return _named(schemas.ACTIONS, cls)


def class_severity(cls) -> Column:
    return F.when(as_column(cls) == 2, "HAUTE").otherwise("MOYENNE")


def status_label(status) -> Column:
    pairs = [F.lit(v) for kv in schemas.STATUS_LABELS.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[as_column(status)], as_column(status))


def task_minutes(quantity, p: Params = DEFAULTS) -> Column:
    minutes = as_column(quantity) / F.lit(p.units_per_minute)
    bounded = F.greatest(F.lit(1.0), F.least(minutes, F.lit(2.0 ** 31 - 1))).cast("int")
    return F.when(minutes.isNull(), F.lit(1)).otherwise(bounded)


# ---- clocks of tasks and pauses ------------------------------------------

def task_progress(started, minutes, now) -> Column:
    """Share done, at most 1; zero when not started; 1 for a task without duration."""
    share = F.try_divide(seconds_between(started, now), as_column(minutes) * 60.0)
    return F.when(as_column(started).isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.lit(1.0), share), F.lit(1.0)))


def task_done(started, minutes, now) -> Column:
    return as_column(started).isNotNull() & (
        seconds_between(started, now) >= as_column(minutes) * 60.0)


def task_minutes_left(started, minutes, now) -> Column:
    minutes = as_column(minutes).cast("double")
    return F.when(as_column(started).isNull(), minutes).otherwise(
        F.greatest(F.lit(0.0), minutes - seconds_between(started, now) / 60.0))


def pause_seconds_left(started, now, p: Params = DEFAULTS) -> Column:
    left = F.lit(float(p.pause_seconds)) - seconds_between(started, now)
    return F.when(left.isNotNull(), F.greatest(F.lit(0.0), left)).cast("int")


def pause_expired(action, started, now, p: Params = DEFAULTS) -> Column:
    return (as_column(action) == "PAUSE") & (seconds_between(started, now) > p.pause_seconds)


# ---- availability and scores ---------------------------------------------

def availability(state, now, p: Params = DEFAULTS) -> Column:
    """Struct (available, reason); the first obstacle in the ladder wins.

    `state` maps busy_until, etat, action, probability, temperature and load to
    columns; a NULL is the missing value of that field.
    """
    busy = seconds_between(now, state["busy_until"])
    probability = zero_if_null(state["probability"])
    temperature = zero_if_null(state["temperature"])
    load = zero_if_null(state["load"])
    # The texts shown for each obstacle.
    reason = (
        F.when(busy > 0, F.format_string("Occupée (encore %d min)", F.floor(busy / 60).cast("int")))
        .when(state["etat"] == "arrete", F.lit("Machine arrêtée"))
        .when(state["action"] == "ARRETER", F.lit("ML recommande ARRÊT"))
        .when(real(probability) > p.max_failure_probability,
              F.concat(F.lit("Probabilité panne élevée ("), percent(probability), F.lit(")")))
        .when(real(temperature) > p.max_temperature,
              F.concat(F.lit("Température trop élevée ("), temperature.cast("string"),
                       F.lit("°C)")))
        .when(real(load) > p.max_load,
              F.concat(F.lit("Charge trop élevée ("), load.cast("string"), F.lit("%)")))
    )
    return F.struct(reason.isNull().alias("available"),
                    F.coalesce(reason, F.lit("Disponible")).alias("reason"))


def simple_score(temperature, load) -> Column:
    # Weights 0.6 / 0.4, missing temperature 70 and load 50.
    t = F.coalesce(as_column(temperature), F.lit(70.0))
    c = F.coalesce(as_column(load), F.lit(50.0))
    return t / 100.0 * 0.6 + c / 100.0 * 0.4


def detailed_score(temperature, load, action, probability) -> Column:
    # Weights and penalties; missing load 0, temperature 70, probability 0.
    t = F.coalesce(as_column(temperature), F.lit(70.0))
    c = F.coalesce(as_column(load), F.lit(0.0))
    advice = F.when(as_column(action) == "CONTINUER", -15.0).when(
        as_column(action) == "PAUSE", 25.0).otherwise(0.0)
    return (c * 2.0 + F.greatest(F.lit(0.0), t - 80.0) * 1.5 + advice
            + zero_if_null(probability) * 10.0)


def unit_progress(elapsed, duration) -> Column:
    return rounded(clamp(F.try_divide(as_column(elapsed), as_column(duration)), 0.0, 1.0), 3)
