"""Two-version tables derived from the given tables, for Spark and for SQL.

Every row of a source table belongs to exactly one of the two versions (even
ids are the old one, odd ids the new one) or, in the edited variant, to both,
so each query works on whole tables and whole texts. Text is folded to ASCII
because the SQL engine counts bytes in edit distances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ASCII = r"[^\x00-\x7F]"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, line, code: the non-blank lines of all documents."""
    docs = table(spark, folder, "documents")
    split = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "code"))
    return split.where(F.trim("code") != "").select(
        "doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"),
        (F.col("pos") + 1).cast("bigint").alias("line"),
        F.regexp_replace("code", ASCII, "?").alias("code"),
    )


LINES = r"""
lines as (
  select doc_id, concat(source,'/',doc_id) path, line::bigint line,
         regexp_replace(code,'[^\x00-\x7F]','?','g') code
  from (select doc_id, source, unnest(string_split(text,chr(10))) code,
               generate_subscripts(string_split(text,chr(10)),1) line from documents)
  where trim(code) <> '')"""

SPLIT_LINES = LINES + """,
old_src as (select path, line, code from lines where doc_id%2=0),
new_src as (select path, line, code from lines where doc_id%2=1)"""


def _halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    parity = F.pmod(F.col(key), F.lit(2))
    return df.where(parity == 0), df.where(parity == 1)


def split_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    old, new = _halves(lines(spark, folder), "doc_id")
    return old.select("path", "line", "code"), new.select("path", "line", "code")


def edited_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All lines as the old version; the new one loses every 13th line and
    changes every 11th, under other folders and new line numbers."""
    old = lines(spark, folder)
    mark = F.col("doc_id") * 31 + F.col("line") * 7
    from pyspark.sql import Window

    kept = old.where(mark % 13 != 0)
    new = kept.select(
        F.concat(F.lit("new/"), "path").alias("path"),
        F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).cast("bigint").alias("line"),
        F.col("line").alias("true_old_line"),
        F.when(mark % 11 == 0, F.concat("code", F.lit(" x"), ((F.col("doc_id") + F.col("line")) % 5).cast("string")))
        .otherwise(F.col("code")).alias("code"),
    )
    return old.select("path", "line", "code"), new


EDITED_LINES = LINES + """,
old_src as (select path, line, code from lines),
new_src as (
  select concat('new/',path) path,
         row_number() over (partition by doc_id order by line) line,
         line as true_old_line,
         case when (doc_id*31+line*7)%11=0
              then concat(code,' x',cast((doc_id+line)%5 as varchar)) else code end code
  from lines where (doc_id*31+line*7)%13<>0)"""


def functions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, folder, "part")
    rows = part.select(
        F.col("p_partkey").alias("fid"), F.concat("p_name", F.lit("::"), "p_brand").alias("func"),
        F.col("p_type").alias("namespace"), F.col("p_name").alias("basename"),
        F.concat(F.lit("("), "p_brand", F.lit(")")).alias("parameters"),
        F.when(F.col("p_size") % 10 == 0, "cold").otherwise("").alias("extension"),
        (F.col("p_size") % 3 + 1).cast("string").alias("chunk"),
        F.concat("p_type", F.lit("/"), "p_name", F.lit(".cpp")).alias("path"),
        F.col("p_size").cast("bigint").alias("line"),
        (F.col("p_partkey") % 4 == 0).alias("profiled"),
    )
    return _halves(rows, "fid")


FUNCTIONS = """
funcs as (
  select p_partkey fid, concat(p_name,'::',p_brand) func, p_type namespace, p_name basename,
         concat('(',p_brand,')') parameters,
         case when p_size%10=0 then 'cold' else '' end extension,
         cast(p_size%3+1 as varchar) chunk,
         concat(p_type,'/',p_name,'.cpp') path, p_size::bigint line, p_partkey%4=0 profiled
  from part),
old_f as (select * from funcs where fid%2=0),
new_f as (select * from funcs where fid%2=1)"""


def cfg(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with their follower; fid is the order, bid the place of the item in it."""
    from pyspark.sql import Window

    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("fid"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    place = Window.partitionBy("fid").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    bid = (F.row_number().over(place) - 1).cast("bigint")
    count = F.count("*").over(Window.partitionBy("fid"))
    return items.select(
        "fid", bid.alias("bid"), (F.col("l_partkey") % 50).alias("hash"),
        F.col("l_quantity").cast("bigint").alias("cnt"), count.alias("blocks"),
    ).select(
        "fid", "bid", "hash", "cnt", (F.col("bid") * 16).alias("start_off"), (F.col("bid") * 16 + 16).alias("end_off"),
        F.when(F.col("bid") + 1 < F.col("blocks"), F.col("bid") + 1).alias("next_bid"),
    )


CFG = """
cfg as (
  select fid,bid,hash,cnt,bid*16 start_off,bid*16+16 end_off,
         lead(bid) over (partition by fid order by bid) next_bid
  from (select l_orderkey fid,
               row_number() over (partition by l_orderkey
                 order by l_linenumber,l_partkey,l_suppkey)-1 bid,
               l_partkey%50 hash, cast(l_quantity as bigint) cnt from lineitem) q)"""


def page_paths(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, folder, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    old, new = _halves(pages.select("page_id", bare.alias("path")), "page_id")
    return old.select("path").distinct(), new.select("path").distinct()


PAGE_PATHS = r"""
paths as (
  select page_id, regexp_replace(regexp_replace(url,'^[a-z]+://',''),'[?#].*$','') path from pages),
old_p as (select distinct path from paths where page_id%2=0),
new_p as (select distinct path from paths where page_id%2=1)"""
