"""touchline — match analytics on Spark.

Two-sided contests (home side, away side, score, date) as lazy
``DataFrame -> DataFrame`` operators: cleaning and validation, a normalised
star schema, league tables, pre-match form and Elo features, Poisson and
random-forest outcome models and evaluation.
"""

__version__ = "0.1.0"
