"""Queries J14: held-out passages and fragments of them in the whole corpus."""

from pyspark.sql import functions as F

from colloquy.operators import containment as CT
from colloquy.plans.registry import cte, query
from colloquy.sources import driver_tables as D


@query("J14_contained_passages", """
  SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b
    ON length(b.text) >= 25 AND contains(lower(d.text), lower(b.text))""")
def j14(spark, path):
    return CT.contained(D.table(spark, path, "documents"), D.table(spark, path, "benchmark"))


cte("fragment", r"""
  SELECT item_id || '/2' AS item_id, regexp_extract(text, '\S+\s\S+$') AS text FROM benchmark
  UNION ALL SELECT item_id || '/1', regexp_extract(text, '\S+$') FROM benchmark
""")


@query("J14_contained_fragments", """
  SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN fragment b
    ON length(b.text) >= 4 AND contains(lower(d.text), lower(b.text))""")
def j14_fragments(spark, path):
    b = D.table(spark, path, "benchmark")
    ends = [b.select(F.concat_ws("/", "item_id", F.lit(n)).alias("item_id"), F.regexp_extract("text", p, 0).alias("text"))
            for n, p in (("2", r"\S+\s\S+$"), ("1", r"\S+$"))]
    return CT.contained(D.table(spark, path, "documents"), ends[0].unionByName(ends[1]), min_chars=4)
