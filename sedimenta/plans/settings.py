"""Parameters of the Q&A lakehouse."""

from __future__ import annotations

import datetime as dt

# The tracked tags, in order, and their categories.
TAG_CATEGORIES = {
    "pandas": "DataFrame and query engines",
    "numpy": "DataFrame and query engines",
    "python-polars": "DataFrame and query engines",
    "duckdb": "DataFrame and query engines",
    "apache-spark": "Big data",
    "pyspark": "Big data",
    "scikit-learn": "Machine learning",
    "tensorflow": "Machine learning",
    "pytorch": "Machine learning",
    "matplotlib": "Visualisation and BI",
    "powerbi": "Visualisation and BI",
    "tableau-api": "Visualisation and BI",
    "airflow": "Data platforms and orchestration",
    "dbt": "Data platforms and orchestration",
    "databricks": "Data platforms and orchestration",
    "snowflake-cloud-data-platform": "Data platforms and orchestration",
    "sql": "Languages",
    "r": "Languages",
}
TRACKED = tuple(TAG_CATEGORIES)
# The calendar reaches at least over these days; the marker splits it in two.
CALENDAR_FROM, CALENDAR_TO, MARKER = dt.date(2022, 11, 1), dt.date(2022, 11, 30), dt.date(2022, 11, 30)
SALT = "test-salt"
