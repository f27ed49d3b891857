"""Lists of venues to search within."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The six lists by name.
PRESETS = {
    "UTD24": (
        "The Accounting Review", "Journal of Accounting and Economics", "Journal of Accounting Research",
        "Journal of Finance", "Journal of Financial Economics", "Review of Financial Studies",
        "Academy of Management Journal", "Academy of Management Review", "Strategic Management Journal",
        "Journal of Marketing", "Journal of Marketing Research", "Marketing Science",
        "Information Systems Research", "MIS Quarterly", "INFORMS Journal on Computing",
        "Operations Research", "Management Science", "Manufacturing & Service Operations Management",
        "American Economic Review", "Econometrica", "Journal of Political Economy",
        "Administrative Science Quarterly", "Journal of International Business Studies", "Organization Science",
    ),
    "FT50": (
        "The Accounting Review", "Journal of Accounting and Economics", "Journal of Accounting Research", "Contemporary Accounting Research",
        "Review of Accounting Studies", "Accounting Organizations and Society", "Auditing: A Journal of Practice & Theory",
        "Journal of Finance", "Journal of Financial Economics", "Review of Financial Studies", "Journal of Financial and Quantitative Analysis",
        "Review of Finance", "Journal of Money Credit and Banking", "Mathematical Finance",
        "Academy of Management Journal", "Academy of Management Review", "Administrative Science Quarterly", "Strategic Management Journal",
        "Journal of International Business Studies", "Organization Science", "Organization Studies", "Journal of Management",
        "Journal of Management Studies", "Human Resource Management",
        "Journal of Marketing", "Journal of Marketing Research", "Marketing Science", "Journal of Consumer Research", "Journal of the Academy of Marketing Science",
        "Information Systems Research", "MIS Quarterly", "Journal of Management Information Systems",
        "Operations Research", "Management Science", "Manufacturing & Service Operations Management", "Production and Operations Management", "Journal of Operations Management",
        "American Economic Review", "Econometrica", "Journal of Political Economy", "Quarterly Journal of Economics", "Review of Economic Studies", "Journal of Business Ethics",
        "Entrepreneurship Theory and Practice", "Journal of Business Venturing", "Research Policy", "Journal of Consumer Psychology",
        "Journal of Applied Psychology", "Organizational Behavior and Human Decision Processes", "Harvard Business Review",
    ),
    "nature_science": ("Nature", "Science", "Cell", "Proceedings of the National Academy of Sciences"),
    "ml_top_venues": (
        "Neural Information Processing Systems", "International Conference on Machine Learning", "International Conference on Learning Representations",
        "Journal of Machine Learning Research", "Conference on Computer Vision and Pattern Recognition", "Association for Computational Linguistics",
    ),
    "medical_top": ("The New England Journal of Medicine", "The Lancet", "JAMA", "BMJ", "Nature Medicine", "Cell"),
    "Cochrane": ("Cochrane Database of Systematic Reviews",),
}


def preset(name: str) -> tuple[str, ...]:
    if name not in PRESETS:
        raise ValueError(f"no such list of venues: {name!r}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def table(spark: SparkSession) -> DataFrame:
    """preset and venue (lower case)."""
    return spark.createDataFrame([(p, v.lower()) for p, names in PRESETS.items() for v in names], "preset string, venue string")


def with_presets(corpus: DataFrame, venue: str) -> DataFrame:
    """The records of all lists with preset; one that stands in several lists comes once for each."""
    listed = table(corpus.sparkSession).withColumnRenamed("venue", "_venue")
    return corpus.join(F.broadcast(listed), F.lower(F.trim(F.col(venue))) == F.col("_venue")).drop("_venue")  # under a hundred names
