"""panelscope: panel-survey analytics (units observed over ordered rounds, joined to a
geographic hierarchy) expressed as Spark DataFrame plans.

Layout
------
sources/    schemas, loaders, the Parquet layout writer, the test-table binding
functions/  Column-expression helpers (rounding, safe division, labels, tiers)
operators/  reusable DataFrame operators (audits, KPIs, panel windows, ranks, DiD, scores)
plans/      the five views and every report, plus their SQL oracles
streaming/  the national dashboard maintained over a stream of observation files
"""

__version__ = "0.1.0"
