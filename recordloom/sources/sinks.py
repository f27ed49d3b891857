"""Exports: BibTeX, RIS, CSV and JSON, as Columns and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bibtex_keys(df: DataFrame, author: str, year: str, order: list[str]) -> DataFrame:
    """LastYear; the second of a key gets b, the third c, and so on. The last name is what stands before
    a comma, else the last word; ASCII letters and digits of it stay. The numbering needs a key's rows
    together: keys are about as many as rows."""
    name = F.trim(F.coalesce(F.col(author), F.lit("")))
    last = F.when(F.contains(name, F.lit(",")), F.substring_index(name, ",", 1)).otherwise(F.element_at(F.split(name, r"\s+"), -1))
    clean = F.regexp_replace(last, "[^A-Za-z0-9]", "")
    key = F.concat(F.when(clean == "", "Anon").otherwise(clean), F.coalesce(F.when(F.col(year) != 0, F.col(year).cast("string")), F.lit("n.d.")))
    n = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    out = df.withColumn("_key", key).withColumn("_n", n)
    suffix = F.when(F.col("_n") == 1, "").when(F.col("_n") <= 26, F.char(96 + F.col("_n"))).otherwise(F.col("_n").cast("string"))
    return out.withColumn("bibtex_key", F.concat("_key", suffix)).drop("_key", "_n")


def bibtex_escaped(c: Column) -> Column:
    """A backslash before each sign that means something in TeX."""
    return F.regexp_replace(c, r"([\\{}&%$#_])", r"\\$1")


def bibtex_type(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(F.contains(k, F.lit("book")), "book").when(k.rlike("preprint|arxiv|dataset"), "misc").otherwise("article")


def ris_type(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(F.contains(k, F.lit("book")), "BOOK").when(k.rlike("preprint|arxiv"), "UNPD").when(F.contains(k, F.lit("dataset")), "DATA").otherwise("JOUR")


def bibtex(df: DataFrame) -> DataFrame:
    """entry: one BibTeX entry per record with bibtex_key, type, title, names, year, venue, doi."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), bibtex_escaped(c), F.lit("}")))
    fields = F.array_compact(F.array(line("title", F.col("title")), line("author", F.array_join("names", " and ")), line("year", F.col("year").cast("string")), line("journal", F.col("venue")), line("doi", F.col("doi"))))
    return df.select(F.concat(F.lit("@"), bibtex_type(F.col("type")), F.lit("{"), "bibtex_key", F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n")).alias("entry"))


def ris(df: DataFrame) -> DataFrame:
    tag = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}  - "), F.trim(F.regexp_replace(c, r"\s+", " "))))
    names = F.array_join(F.transform("names", lambda n: F.concat(F.lit("AU  - "), n)), "\n")
    lines = F.array_compact(F.array(tag("TY", ris_type(F.col("type"))), tag("TI", F.col("title")), F.when(names != "", names), tag("PY", F.col("year").cast("string")), tag("JO", F.col("venue")), tag("DO", F.col("doi")), tag("AB", F.col("abstract"))))
    return df.select(F.concat(F.array_join(lines, "\n"), F.lit("\nER  - \n")).alias("entry"))


def exportable(df: DataFrame, least: int = 5) -> DataFrame:
    return df.filter(F.coalesce("rcs", F.lit(0)) >= least).orderBy(F.desc_nulls_last("rcs"), F.desc("citation_count"))


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by '; '."""
    flat = [F.array_join(F.col(n).cast("array<string>"), "; ").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_text(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").text(path)


def csv_line(columns: list[Column]) -> Column:
    """Strings as a line of comma-separated values; quoted where they hold a comma, quote or line end."""
    quoted = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *[quoted(F.coalesce(c, F.lit(""))) for c in columns])


def write_single(rows: DataFrame, order: str, text: str, path: str, between: str = "\n", head: str = "", tail: str = "", ends: bool = False) -> None:
    """Write ``text`` of all rows, in ``order``, as one file: ``head``, the texts with ``between`` between
    them (after the last one too if ``ends``), ``tail``. Null texts are empty.

    Tasks write the parts, which are ranges of the order; the driver joins them as byte streams, so it
    holds a buffer of one part and no rows. The file appears under its name only once it is whole."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts, made = f"{path}.parts-{uuid.uuid4().hex}", f"{path}.made-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select(F.coalesce(text, F.lit(""))).write.option("lineSep", between).text(parts)
    listed = [(s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(at(parts))]
    files = sorted(((int(name.split("-")[1]), name, p, size) for name, p, size in listed if name.startswith("part-") and size), key=lambda f: f[:2])
    out = fs.create(at(made), True)
    try:
        out.write(bytearray(head.encode()))
        for n, (_, _, p, size) in enumerate(files):
            source = fs.open(p)
            if n == len(files) - 1 and not ends:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.org.apache.commons.io.input.BoundedInputStream(source, size - len(between.encode())), out, 1 << 20, False)
            else:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(at(parts), True)
    fs.delete(at(path), False)
    if not fs.rename(at(made), at(path)):
        raise OSError(f"couldn't put the file in its place: {path}")
