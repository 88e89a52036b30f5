"""reelspark — rating analytics and recommendations as Spark DataFrame jobs.

Every operator takes DataFrames keyed by ``user_id`` and returns a DataFrame; nothing is
collected to the driver except bounded, model-sized results (fitted coefficients, a handful of
hyper-parameter rows).
"""

__version__ = "0.1.0"
