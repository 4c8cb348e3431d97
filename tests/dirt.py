"""Dirty copies of the smallest tables: rows of nulls, repeated rows, very long and odd texts, extra columns with names that operators use."""

import glob

from pyspark.sql import functions as F

CLASHING = ("key", "n", "site", "term", "a", "b", "rep", "h", "hash", "clean", "value", "rank", "score", "size", "chunk", "tokens_", "variant", "pos", "q", "x", "measure", "bin", "cell", "salt")


def dirty_tables(spark, folder, target):
    for path in glob.glob(f"{folder}/*.parquet"):
        name = path.rsplit("/", 1)[1]
        df = spark.read.parquet(path)
        nulls = spark.range(3).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        half = df.limit(40).select(*[F.when(F.rand(len(c)) < 0.7, F.col(c)).alias(c) for c in df.columns])
        texts = [c for c, t in df.dtypes if t == "string" and c in ("text", "page_text", "answer", "question", "answer_ref")]
        long = df.limit(1)
        for c in texts:
            long = long.withColumn(c, F.repeat(F.concat(F.coalesce(c, F.lit("x")), F.lit(" 🙂\u0000퟿.\n")), 60))
        out = df.unionByName(nulls).unionByName(half).unionByName(df.limit(15)).unionByName(long)
        for i, c in enumerate(CLASHING):
            if c not in df.columns:
                out = out.withColumn(c, F.lit(i) if i % 2 else F.lit("clash"))
        out.write.parquet(f"{target}/{name}")
    return str(target)
