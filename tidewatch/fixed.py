"""Fixed values that results depend on. Kept together, in natural order, as plain text."""

# --- Fixed values: labelled time intervals for the `events` stand-in table -----------
# Closed on both ends, disjoint, timezone-free (interval_id, start, end).
EVENT_INTERVALS = [
    (1, "2024-01-03 06:00:00", "2024-01-03 12:30:00"),
    (2, "2024-01-07 09:15:00", "2024-01-07 21:45:00"),
    (3, "2024-01-11 00:00:00", "2024-01-12 03:20:00"),
    (4, "2024-01-16 13:05:10", "2024-01-17 01:00:00"),
    (5, "2024-01-22 17:40:00", "2024-01-23 08:00:00"),
    (6, "2024-01-27 02:30:30", "2024-01-29 10:10:10"),
]

# --- Fixed values: label words -----------------------------------------------------
HIT_LABEL = "attack"
MISS_LABEL = "normal"

# --- Fixed values: Cramer-von Mises, fully specified null distribution ----------------
# Upper-tail critical values of Stephens' modified statistic
# W* = (W2 - 0.4/n + 0.6/n^2) * (1 + 1/n), keyed by significance level.
CVM_CRITICAL = {0.15: 0.284, 0.10: 0.347, 0.05: 0.461, 0.025: 0.581, 0.01: 0.743}

# --- Fixed values: Abramowitz-Stegun 7.1.26 erf approximation (|error| <= 1.5e-7) ----
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
