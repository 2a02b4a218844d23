"""Question routing and small classifications as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Phrases, measures and nouns of questions about the collection itself.
INVENTORY_PHRASES = (
    "how many files|total size|disk space|storage used|how much is indexed|how much storage|index size|how large|file count|how much space|total indexed|"
    "what's in my index|whats in my index|how big is|storage usage|space used|what is in my index|what is indexed|what's indexed|what have i indexed|what did i index|"
    "how many items|item count|how much of my drive|drive usage|how full|how much data|data indexed|indexed data|folder size|directory size|index summary|folder count|"
    "what types of files|file types indexed|extension breakdown|show stats|index stats|storage stats"
)
MEASURES = r"how many|how much|how large|how big|how full|\b(?:count|total|size|usage|stats|breakdown|capacity|kinds|types|extensions|formats)\b"
NOUNS = r"\b(?:files?|folders?|index|storage|disk|drive|documents?|items?|indexed|pdfs?|collection)\b"
OWNED = r"\bdo i have (?:more|any|fewer|many)\b"
TOPIC = r"\b(?:about|regarding|concerning|mention\w*|related to)\s+\w"
LISTING = r"\b(?:list|show|enumerate|give me a list of|what are)\s+(?:(?:all|my|the|of)\s+)*(?:indexed\s+)?(?:files|folders|documents|indexed\b(?!\s+\w))\b"
COLLECTION = "index|indexed|library|collection|corpus|storage|disk|drive|files?|folders?|documents?|projects?|workspace|repos|codebases?"
#: A determiner phrase whose head isn't the collection: the question is about something else.
ELSEWHERE = (
    r"\b(?:in|of|for|from|by|on|does|do|did|is|are|was|were)\s+(?:the|a|an|this|that|these|those|my|your|his|her|their|its|our)\s+"
    rf"(?!(?:{COLLECTION})\b)\w+"
)


def intents(question: Column) -> list[Column]:
    low = F.lower(question)
    latest, largest = question.rlike(tx.LATEST), question.rlike(tx.LARGEST)
    return [
        latest.alias("latest"),
        largest.alias("largest"),
        low.rlike(tx.PROJECT).alias("project"),
        low.rlike(tx.METADATA).alias("metadata"),
        (question.rlike(tx.GRAPH) & question.rlike(tx.CODE_SIGNAL)).alias("graph"),
        (latest | largest | F.contains(low, F.lit("how many files"))).alias("inventory"),
    ]


def mode(question: Column) -> Column:
    """FAST_METADATA, FAST_PROJECT, GRAPH_SEARCH or FULL_RAG."""
    low = F.lower(question)
    about_collection = low.rlike(INVENTORY_PHRASES) | (low.rlike(NOUNS) & (low.rlike(MEASURES) | low.rlike(OWNED))) | low.rlike(LISTING)
    elsewhere = low.rlike(ELSEWHERE)
    wants_list = question.rlike(tx.LATEST) | question.rlike(tx.LARGEST)
    return (
        F.when(about_collection & ~low.rlike(TOPIC) & ~elsewhere & ~wants_list, "FAST_METADATA")
        .when(low.rlike(tx.METADATA) & low.rlike(tx.PROJECT) & ~elsewhere, "FAST_PROJECT")
        .when(question.rlike(tx.GRAPH) & question.rlike(tx.CODE_SIGNAL), "GRAPH_SEARCH")
        .otherwise("FULL_RAG")
    )


def model_class(name: Column, threshold: float = 4.0) -> Column:
    size = tx.largest_billions(name)
    return F.when(size < threshold, "3b_local").when(size.isNotNull(), "7b_local").when(F.lower(name).rlike("mini|small"), "small_cloud").otherwise("large_cloud")


def page_class(text: Column, has_image: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, "BLANK").when((n < 40) & has_image, "OCR").when(n < 10, "BLANK").when(tx.garbage_ratio(text) > 0.2, "OCR").otherwise("NATIVE")
