"""Texts to run on: whole tables, and notes templated from keys so that every rule has
something to find. The template is one SQL expression that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import CLASSES

NOTES_FROM, PAPERS_FROM = 1_000_000_000, 2_000_000_000


def note_sql(key: str) -> str:
    """A note about the key."""
    s = lambda x: f"CAST({x} AS STRING)"
    pad = lambda x, n, c="0": f"lpad({s(x)}, {n}, '{c}')"
    k, nl, back = key, "chr(10)", "chr(92)"
    parts = [
        "Support case CASE-", s(f"{k} + 10000"), " under contract CTR-", s(f"{k} + 20000"), " for CUST-", s(f"{k} + 30000"), " by EMP-", s(f"{k} + 40000"), " ref ABC-", s(f"{k} + 5000"), ".", nl,
        "Mail user", s(k), "@mail", s(f"{k} % 7"), ".example.com or call +1 555 ", pad(f"{k} % 1000", 3), " ", pad(f"{k} % 10000", 4), ", host SQL-PROD-", s(f"{k} % 90 + 10"), ", site app", s(k), ".corp.local.", nl,
        "Seen at 10.", s(f"{k} % 300"), ".3.", s(f"{k} % 256"), " on version 12.1.2.4, mac 00:1B:44:11:3A:", pad(f"{k} % 90", 2), ", fe80:0:0:", s(f"{k} % 9"), ":abcd:1:2:3, 00000000-0000-4000-8000-", pad(k, 12), ".", nl,
        "Card 4111 1111 1111 1111 or 4000 0000 0000 ", pad(f"{k} % 10000", 4), ", id number ", s(f"8001015009000 + {k}"), " and 80010150", pad(f"{k} % 100000", 5), ", GB29 NWBK 6016 1331 9268 19, ", pad(f"{k} % 1000", 3), "-12-", pad(f"{k} % 10000", 4), ".", nl,
        "AKIA", pad(k, 16), " ghp_", pad(k, 36, "a"), " xoxb-", pad(k, 12), " AIza", pad(k, 35, "b"), " sk_live_", pad(k, 20), " sk-ant-", pad(k, 24, "c"), " eyJ", pad(k, 10, "d"), ".", pad(k, 10, "e"), ".", pad(k, 10, "f"), " Bearer ", pad(k, 20, "g"), ".", nl,
        "postgres://u:p@db", s(k), "/x Server=db", s(k), ";Uid=a;Password=p", s(k), "w;", nl, "password: \"pw", s(k), "x\" api_key = key", pad(k, 8), " https://example.org/page/", s(k), "?id=", s(k), ", www.example.net/help.", nl,
        "Share ", back, back, "fs", s(k), back, "data, key ABCD", s(f"{k} % 9"), "-EFGH2-IJKL3-MNOP4.", nl,
        "Project Falcon launches in Q", s(f"{k} % 4 + 1"), " 2027; the private beta begins in March with ", s(f"{k} % 90 + 5"), "% discount at a price of $", s(k), "k.", nl,
        "-----BEGIN RSA PRIVATE KEY-----", nl, pad(k, 12, "z"), nl, "-----END RSA PRIVATE KEY-----",
    ]
    return " || ".join(p if p.startswith(("CAST(", "lpad(", "chr(")) else f"'{p}'" for p in parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer partitions than cores, dealt out to all cores; larger
    inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


#: Rows of such a table that a task makes texts from, at most: what a task groups or holds on the
#: way doesn't grow with the table.
ROWS_A_TASK = 20_000


def tasks(df: DataFrame) -> int:
    """How many tasks make texts from a table's rows."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def dealt(df: DataFrame) -> DataFrame:
    """Rows that texts are made from, dealt out to all cores: such tables are small, and few of
    their files' parts may hold all rows."""
    return df.repartition(tasks(df))


def gathered(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """Rows with all of a document's in one task. Nearly every document has its values for itself,
    so tables of them that the scan's tasks would fill before a shuffle save nothing; and there
    are as many tasks as texts ask for, so that none groups more as tables grow."""
    return rows.repartition(max(tasks(table(spark, sf_dir, "customer")), int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each customer."""
    return dealt(table(spark, sf_dir, "customer").select("c_custkey")).select((F.col("c_custkey") + NOTES_FROM).alias("doc_id"), F.expr(note_sql("c_custkey")).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all notes."""
    return documents(spark, sf_dir).unionByName(notes(spark, sf_dir))


def paper_sql(key: str) -> str:
    """A paper in the words of the class that the key falls on, with rows of a plan."""
    cases = []
    for k, c in enumerate(CLASSES):
        held = " and ".join(c.strong + c.terms).replace("'", "''")
        cases.append(f"WHEN {k} THEN 'About {c.label}' || chr(10) || 'It has {held}.'")
    rows = " || ".join(f"chr(10) || 'Q{n} 20' || lpad(CAST({key} % 9 + 25 AS STRING), 2, '0') || ' step {n}'" for n in (1, 2, 3))
    return f"CASE {key} % {len(CLASSES)} {' '.join(cases)} END || chr(10) || 'INTERNAL PRICING' || {rows}"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and a paper for each customer."""
    made = dealt(table(spark, sf_dir, "customer").select("c_custkey")).select((F.col("c_custkey") + PAPERS_FROM).alias("doc_id"), F.expr(paper_sql("c_custkey")).alias("text"))
    return documents(spark, sf_dir).unionByName(made)


PAPERS_SQL = f"select doc_id, text from documents union all select c_custkey + {PAPERS_FROM} as doc_id, {paper_sql("c_custkey")} as text from customer"
NOTES_SQL = f"select c_custkey + {NOTES_FROM} as doc_id, {note_sql('c_custkey')} as text from customer"
CORPUS_SQL = f"select doc_id, text from documents union all {NOTES_SQL}"
