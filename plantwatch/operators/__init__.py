"""DataFrame-to-DataFrame operators. `as_of` is passed in; nothing reads a clock."""
