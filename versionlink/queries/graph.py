"""Queries that link instructions and blocks, and that carry counts over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from versionlink.functions.text import file_name
from versionlink.operators.assign import Tier, retire, unique_mutual_best
from versionlink.plans import blocks, items, overlap, project
from versionlink.plans.pipeline import Version, link_versions
from versionlink.queries import fixtures as fx
from versionlink.queries.link import unique_rounds
from versionlink.queries.registry import query
from versionlink.queries.text import edit
from versionlink.session import keep, settle
from versionlink.sinks import block_rows, cross_rows


def _halves(df: DataFrame, column: str = "fid") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column) % 2 == 0), df.where(F.col(column) % 2 == 1)


SIDES = f"""{fx.CFG},
  old_n as (select * from cfg where fid%2=0), new_n as (select * from cfg where fid%2=1),
  fmap as (select distinct o.fid old_fid, n.fid new_fid from old_n o join new_n n on n.fid=o.fid+1)"""


def _sides(spark: SparkSession, folder: str):
    cfg = keep(fx.cfg(spark, folder))
    old, new = _halves(cfg)
    func_map = old.select(F.col("fid").alias("old_fid")).distinct().withColumn("new_fid", F.col("old_fid") + 1)
    func_map = keep(func_map.join(new.select(F.col("fid").alias("new_fid")).distinct(), "new_fid", "left_semi"))
    edge = lambda side: side.where("next_bid is not null").select(
        F.col("fid").alias("src_fid"), F.col("bid").alias("src_bid"), F.col("fid").alias("dst_fid"), F.col("next_bid").alias("dst_bid"))
    return old, new, edge(old), edge(new), func_map


HASHED = f"""{SIDES},
  hp as (select distinct old_fid, o.bid old_bid, new_fid, n.bid new_bid from fmap join old_n o on o.fid=old_fid join new_n n on n.fid=new_fid and n.hash=o.hash),
  seed as materialized (select old_fid, old_bid, new_fid, new_bid from (select *, count(*) over (partition by old_fid,old_bid) a, count(*) over (partition by new_fid,new_bid) b from hp) where a=1 and b=1)"""


@query("block_hash_seed", f"with {HASHED} select * from seed")
def block_hash_seed(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, _, func_map = _sides(spark, folder)
    return blocks.link_blocks_by_hash(func_map, old, new)


CANDIDATES = """
  cand as (select old_fid, o.bid old_bid, new_fid, n.bid new_bid from fmap join old_n o on o.fid=old_fid join new_n n on n.fid=new_fid
           where (old_fid,o.bid) not in (select (old_fid,old_bid) from seed) and (new_fid,n.bid) not in (select (new_fid,new_bid) from seed))"""


def votes_sql(via: str, to: str) -> str:
    own = {"src": "bid", "dst": "next_bid"}
    return f"""
      v_{to} as (select c.old_fid, c.old_bid, c.new_fid, c.new_bid, count(*) votes
        from cand c join old_n eo on eo.fid=c.old_fid and eo.{own[to]}=c.old_bid and eo.next_bid is not null
        join seed s on s.old_fid=eo.fid and s.old_bid=eo.{own[via]}
        join new_n en on en.fid=s.new_fid and en.{own[via]}=s.new_bid and en.next_bid is not null and en.fid=c.new_fid and en.{own[to]}=c.new_bid
        group by all)"""


def _votes(spark: SparkSession, folder: str, via: str, to: str) -> DataFrame:
    old, new, old_edge, new_edge, func_map = _sides(spark, folder)
    seed = keep(blocks.link_blocks_by_hash(func_map, old, new))
    return blocks.votes_beside_links(func_map, seed, old_edge, new_edge, via, to)


@query("block_successor_votes", f"with {HASHED}, {CANDIDATES}, {votes_sql('src', 'dst')} select * from v_dst")
def successor_votes(spark: SparkSession, folder: str) -> DataFrame:
    return _votes(spark, folder, "src", "dst")


@query("block_predecessor_votes", f"with {HASHED}, {CANDIDATES}, {votes_sql('dst', 'src')} select * from v_src")
def predecessor_votes(spark: SparkSession, folder: str) -> DataFrame:
    return _votes(spark, folder, "dst", "src")


@query("block_link_by_votes", f"""
  with {HASHED}, {CANDIDATES}, {votes_sql('src', 'dst')},
  {unique_rounds("v_dst", "old_fid,old_bid", "new_fid,new_bid", ["votes"], 1, "old_fid, old_bid, new_fid, new_bid")} select * from won""")
def link_by_votes(spark: SparkSession, folder: str) -> DataFrame:
    votes = settle(_votes(spark, folder, "src", "dst"))
    return unique_mutual_best(votes, blocks.OLD, blocks.NEW, [Tier("votes")]).select(*blocks.BLOCKS)


OPCODES = ["mov", "movl", "movq", "mul", "jmp", "je", "jne", "add", "addl", "and"]

ITEMS = f"""
  it as (select l_orderkey fid, l_orderkey//2 k, (l_linenumber//3)::bigint bid, (l_partkey%3)::bigint line,
           l_orderkey*1000+row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey) idx,
           (['{"','".join(OPCODES)}'])[l_partkey%{len(OPCODES)}+1] opcode,
           case when l_partkey%{len(OPCODES)} between 4 and 6 then concat('<f',l_suppkey%4,'+0x',lower(to_hex(l_partkey)),'>') else concat('%r',l_suppkey%9) end operand from lineitem),
  di as (select distinct fid, k, bid, line, idx, opcode, operand from it),
  oi as (select *, substr(opcode,1,1) oid from di where fid%2=0), ni as (select *, substr(opcode,1,1) oid from di where fid%2=1),
  pr as (select o.fid old_fid, o.bid old_bid, o.idx old_index, n.fid new_fid, n.bid new_bid, n.idx new_index, o.line, o.opcode oo, n.opcode no, o.operand op, n.operand np,
                round({edit('o.opcode', 'n.opcode')},10) ops, o.oid from oi o join ni n on n.k=o.k and n.line=o.line and n.oid=o.oid),
  bp as (select * from (select *, max(ops) over (partition by old_fid,new_fid,line,old_index) mo, max(ops) over (partition by old_fid,new_fid,line,new_index) mn from pr) where ops=mo or ops=mn),
  tg as (select *, case when oid='j' then nullif(regexp_extract(op,'<(.+)\\+0x([0-9a-f]+)>',1),'') end oj, case when oid='j' then nullif(regexp_extract(np,'<(.+)\\+0x([0-9a-f]+)>',1),'') end nj,
             case when oid='j' then ('0x'||nullif(regexp_extract(op,'<(.+)\\+0x([0-9a-f]+)>',2),''))::bigint end ox, case when oid='j' then ('0x'||nullif(regexp_extract(np,'<(.+)\\+0x([0-9a-f]+)>',2),''))::bigint end nx from bp),
  sc as materialized (select old_fid, old_bid, old_index, new_fid, new_bid, new_index,
      case when oj is not null and nj is not null then round({edit('oj', 'nj')},10)+ops end jump_func_score, ops opcode_match_score,
      -abs(ox-nx) jump_diff_score, round({edit('op', 'np')},10) operand_match_score from tg)"""


def _item_candidates(spark: SparkSession, folder: str) -> DataFrame:
    line_items = fx.table(spark, folder, "lineitem")
    n = F.col("l_partkey") % len(OPCODES)
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    code = F.element_at(F.array(*[F.lit(o) for o in OPCODES]), (n + 1).cast("int"))
    jump = F.concat(F.lit("<f"), (F.col("l_suppkey") % 4).cast("string"), F.lit("+0x"), F.lower(F.hex("l_partkey")), F.lit(">"))
    operand = F.when(n.between(4, 6), jump).otherwise(F.concat(F.lit("%r"), (F.col("l_suppkey") % 9).cast("string")))
    rows = line_items.select(
        F.col("l_orderkey").alias("fid"), F.expr("l_linenumber div 3").alias("bid"), F.lit("f").alias("path"),
        (F.col("l_partkey") % 3).alias("line"), (F.col("l_orderkey") * 1000 + F.row_number().over(place)).alias("address"),
        F.concat(code, F.lit("\t"), operand).alias("instruction"))
    old, new = _halves(keep(rows))
    spot = lambda side, s: side.select(F.col("fid").alias(f"{s}_fid"), F.col("path").alias(f"{s}_path"), F.col("line").alias(f"{s}_line"),
                                        F.expr("fid div 2").alias("k"), F.col("line").alias("on")).distinct()
    links = spot(old, "old").join(spot(new, "new"), ["k", "on"]).drop("k", "on")
    # lines of different functions are different places here
    named = lambda side: side.withColumn("path", F.expr("cast(fid div 2 as string)"))
    links = links.withColumn("old_path", F.expr("cast(old_fid div 2 as string)")).withColumn("new_path", F.col("old_path"))
    return items.item_candidates(named(old), named(new), links)


@query("item_candidates", f"with {ITEMS} select * from sc")
def item_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _item_candidates(spark, folder)


def item_rounds(rounds: int) -> str:
    left, right = "old_fid,old_bid,old_index,new_fid,new_bid", "new_fid,new_bid,new_index,old_fid,old_bid"
    ctes, open_rows = [], "sc"
    for i in range(rounds):
        previous = open_rows
        for j, score in enumerate(["jump_func_score", "opcode_match_score", "jump_diff_score", "operand_match_score"]):
            same = "is not distinct from" if j == 2 else "="
            ctes.append(f"""t{i}_{j} as materialized (select * exclude (ba,bb) from (select *, max({score}) over (partition by {left}) ba,
              max({score}) over (partition by {right}) bb from {previous}) where {score} {same} ba and {score} {same} bb)""")
            previous = f"t{i}_{j}"
        ctes.append(f"""w{i} as materialized (select * exclude (ra,rb,ca,cb) from (
          select *, rank() over (partition by {left} order by new_index) ra, rank() over (partition by {right} order by old_index) rb,
                 count(*) over (partition by {left}, new_index) ca, count(*) over (partition by {right}, old_index) cb from {previous}) where ra+(ca-1)/2.0=rb+(cb-1)/2.0)""")
        ctes.append(f"""o{i} as materialized (select * from {open_rows} where (old_fid,old_bid,old_index) not in (select (old_fid,old_bid,old_index) from w{i})
          and (new_fid,new_bid,new_index) not in (select (new_fid,new_bid,new_index) from w{i}))""")
        open_rows = f"o{i}"
    return ",\n".join(ctes) + ",\nimap as materialized (" + " union all ".join(f"select * from w{i}" for i in range(rounds)) + ")"


@query("item_links", f"with {ITEMS}, {item_rounds(8)} select * from imap")
def item_links(spark: SparkSession, folder: str) -> DataFrame:
    return items.link_items(_item_candidates(spark, folder))


@query("block_scores", f"""
  with {ITEMS}, {item_rounds(8)}
  select old_fid, old_bid, new_fid, new_bid, round(coalesce(sum(jump_func_score),0),6) jump_func_score, round(coalesce(sum(opcode_match_score),0),6) opcode_match_score,
         coalesce(sum(jump_diff_score),0)::double jump_diff_score, round(coalesce(sum(operand_match_score),0),6) operand_match_score from imap group by all""")
def block_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = blocks.block_scores(items.link_items(_item_candidates(spark, folder)))
    return scores.withColumn("jump_diff_score", F.col("jump_diff_score").cast("double"))


# Candidates as link_blocks takes them: the scored pairs of blocks with linked items, whatever their counts.
SCORED = f"""{HASHED}, {ITEMS}, {item_rounds(8)},
  cand as (select distinct old_fid, old_bid, new_fid, new_bid from imap
           where (old_fid,old_bid) not in (select (old_fid,old_bid) from seed) and (new_fid,new_bid) not in (select (new_fid,new_bid) from seed))"""


def _scored_votes(spark: SparkSession, folder: str, via: str, to: str) -> DataFrame:
    old, new, old_edge, new_edge, func_map = _sides(spark, folder)
    seed = keep(blocks.link_blocks_by_hash(func_map, old, new))
    scored = blocks.block_scores(items.link_items(_item_candidates(spark, folder)))
    return blocks.neighbour_votes(retire(scored, seed, blocks.OLD, blocks.NEW), seed, old_edge, new_edge, via, to)


@query("block_successor_votes_scored", f"with {SCORED}, {votes_sql('src', 'dst')} select * from v_dst")
def successor_votes_scored(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_votes(spark, folder, "src", "dst")


@query("block_predecessor_votes_scored", f"with {SCORED}, {votes_sql('dst', 'src')} select * from v_src")
def predecessor_votes_scored(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_votes(spark, folder, "dst", "src")


@query("block_link_by_votes_scored", f"""
  with {SCORED}, {votes_sql('src', 'dst')} select * from (with
  {unique_rounds("v_dst", "old_fid,old_bid", "new_fid,new_bid", ["votes"], 1, "old_fid, old_bid, new_fid, new_bid")} select * from won)""")
def link_by_votes_scored(spark: SparkSession, folder: str) -> DataFrame:
    votes = keep(_scored_votes(spark, folder, "src", "dst"))
    return unique_mutual_best(votes, blocks.OLD, blocks.NEW, [Tier("votes")]).select(*blocks.BLOCKS)


def block_rounds(rounds: int) -> str:
    """The rounds of block links one after the other: each takes the first step that gives links; the last must find nothing."""
    both_ends = "old_fid,old_bid", "new_fid,new_bid"
    place = "old_fid, old_bid, new_fid, new_bid"
    ctes = []

    def take(name: str, pairs: str, scores: list[str], unless: list[str]) -> None:
        inner = unique_rounds(pairs, *both_ends, scores, 1, place)
        test = " and ".join(f"not exists (select 1 from {u})" for u in unless) or "true"
        ctes.append(f"{name} as materialized (select * from (with {inner} select * from won) where {test})")

    def votes(name: str, via: str, to: str, pairs: str, links: str) -> None:
        own = {"src": "bid", "dst": "next_bid"}
        ctes.append(f"""{name} as materialized (select c.old_fid, c.old_bid, c.new_fid, c.new_bid, count(*) votes
          from {pairs} c join old_n eo on eo.fid=c.old_fid and eo.{own[to]}=c.old_bid and eo.next_bid is not null
          join {links} s on s.old_fid=eo.fid and s.old_bid=eo.{own[via]}
          join new_n en on en.fid=s.new_fid and en.{own[via]}=s.new_bid and en.next_bid is not null and en.fid=c.new_fid and en.{own[to]}=c.new_bid
          group by all)""")

    def without(name: str, pairs: str, won: str) -> None:
        tests = " and ".join(f"({end}) not in (select ({end}) from {won})" for end in both_ends)
        ctes.append(f"{name} as materialized (select * from {pairs} where {tests})")

    scores = blocks.SCORES
    without("rest_0", "bsc", "seed")
    links, rest = "seed", "rest_0"
    for k in range(rounds):
        steps = [f"s{i}_{k}" for i in range(5)]
        take(steps[0], rest, scores[:2], [])
        votes(f"after_{k}", "src", "dst", rest, links)
        take(steps[1], f"after_{k}", ["votes"], steps[:1])
        ctes.append(f"mid_{k} as materialized (select * from {links} union all select * from {steps[1]})")
        without(f"open_{k}", rest, steps[1])
        votes(f"before_{k}", "dst", "src", f"open_{k}", f"mid_{k}")
        take(steps[2], f"before_{k}", ["votes"], steps[:1])
        ctes.append(f"""both_{k} as materialized (select {place}, sum(votes)::bigint votes from
          (select * from after_{k} union all select * from before_{k}) group by all)""")
        take(steps[3], f"both_{k}", ["votes"], steps[:3])
        take(steps[4], rest, scores, steps[:4])
        ctes.append(f"won_{k} as materialized ({' union all '.join(f'select * from {step}' for step in steps)})")
        ctes.append(f"links_{k} as materialized (select * from {links} union all select * from won_{k})")
        without(f"rest_{k + 1}", rest, f"won_{k}")
        links, rest = f"links_{k}", f"rest_{k + 1}"
    last = f"won_{rounds - 1}"
    return f"{', '.join(ctes)} select {place} from {links} union all select -1, -1, -1, -1 from {last}"


@query("block_links", f"""
  with {HASHED}, {ITEMS}, {item_rounds(8)},
  bsc as materialized (select old_fid, old_bid, new_fid, new_bid, round(coalesce(sum(jump_func_score),0),6) jump_func_score, round(coalesce(sum(opcode_match_score),0),6) opcode_match_score,
         coalesce(sum(jump_diff_score),0)::double jump_diff_score, round(coalesce(sum(operand_match_score),0),6) operand_match_score from imap group by all),
  {block_rounds(8)}""")
def block_links(spark: SparkSession, folder: str) -> DataFrame:
    """Hash links, then item scores and neighbour votes until dry."""
    old, new, old_edge, new_edge, func_map = _sides(spark, folder)
    return blocks.link_blocks(old, new, old_edge, new_edge, items.link_items(_item_candidates(spark, folder)), func_map)


WIDE = f"""{SIDES},
  links as (select * from fmap union select distinct o.fid, n.fid from old_n o join new_n n on n.fid=o.fid+3
            union select distinct o.fid, n.fid from (select distinct fid from old_n) o join (select distinct fid from new_n) n on n.fid//20=o.fid//20),
  wide as (select distinct old_fid, o.bid old_bid, new_fid, n.bid new_bid from links join old_n o on o.fid=old_fid join new_n n on n.fid=new_fid and n.hash=o.hash),
  cm as (select old_fid, concat('o',old_fid) old_func, new_fid, concat('n',new_fid) new_func from fmap)"""


def _wide(spark: SparkSession, folder: str):
    """Blocks of the same hash in functions of one file (20 numbers) or with a primary or a secondary link; the primary links and new names."""
    old, new, _, _, func_map = _sides(spark, folder)
    ids = lambda f, s: f.select(F.col("fid").alias(f"{s}_fid")).distinct()
    second = ids(old, "old").withColumn("new_fid", F.col("old_fid") + 3).join(ids(new, "new"), "new_fid", "left_semi")
    file = lambda s: F.expr(f"{s}_fid div 20").alias("file")
    in_file = ids(old, "old").select("old_fid", file("old")).join(ids(new, "new").select("new_fid", file("new")), "file").drop("file")
    links = func_map.select("old_fid", "new_fid").unionByName(second).unionByName(in_file).distinct()
    side = lambda f, s: f.select(F.col("fid").alias(f"{s}_fid"), F.col("bid").alias(f"{s}_bid"), "hash")
    bb_map = links.join(side(old, "old"), "old_fid").join(side(new, "new"), ["new_fid", "hash"]).select(*blocks.BLOCKS).distinct()
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    named = func_map.select("old_fid", name("old_fid", "o").alias("old_func"), "new_fid", name("new_fid", "n").alias("new_func"))
    new_names = new.select("fid", name("fid", "n").alias("func")).distinct()
    return settle(bb_map), settle(named), new_names


@query("link_promotion", f"""
  with {WIDE},
  c as (select old_fid, new_fid, count(*) b from wide group by 1,2),
  best as (select * from (select *, max(b) over (partition by old_fid) x, max(b) over (partition by new_fid) y from c) where b=x and b=y),
  riv as (select b.old_fid, f.old_func, b.new_fid to_fid, concat('n',b.new_fid) to_func, {edit("f.old_func", "concat('n',b.new_fid)")} s
          from best b join cm f on f.old_fid=b.old_fid
          where b.old_fid not in (select b2.old_fid from best b2 join cm m on m.old_fid=b2.old_fid and m.new_fid=b2.new_fid)),
  top as (select * from (select *, max(s) over (partition by old_fid) t from riv) where s=t)
  select cm.old_fid, cm.old_func, coalesce(to_fid,new_fid) new_fid, coalesce(to_func,new_func) new_func from cm left join top on top.old_fid=cm.old_fid""")
def link_promotion(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.promote_links(*_wide(spark, folder))


@query("block_map_rows", f"""with {WIDE} select old_func, old_bid, new_bid from wide join cm using (old_fid,new_fid)""")
def block_map_rows(spark: SparkSession, folder: str) -> DataFrame:
    bb_map, func_map, _ = _wide(spark, folder)
    return block_rows(bb_map, func_map)


@query("cross_map_rows", f"""
  with {WIDE}, multi as (select distinct old_fid, new_fid, concat('o',old_fid) old_func, concat('n',new_fid) new_func from wide)
  select new_func, new_bid, old_func, old_bid from wide join multi using (old_fid,new_fid)
  where (old_fid,new_fid) not in (select (old_fid,new_fid) from cm)""")
def cross_map_rows(spark: SparkSession, folder: str) -> DataFrame:
    bb_map, func_map, _ = _wide(spark, folder)
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    multi = bb_map.select("old_fid", "new_fid").distinct().withColumn("old_func", name("old_fid", "o")).withColumn("new_func", name("new_fid", "n"))
    return cross_rows(bb_map, func_map, multi)


@query("reachable_items", f"""
  with {fx.FUNCTIONS},
  cand as (select o.path op, n.path np, {edit('o.path', 'n.path')} s from (select distinct path, basename from old_f) o join (select distinct path, basename from new_f) n using (basename)),
  linked as (select min(np) path from (select *, max(s) over (partition by op) m from cand) where s=m group by op),
  fm as (select fid+1 fid from old_f where profiled)
  select fid, path from new_f where fid in (select fid from fm) or fid in (select fid from new_f where path in (select path from linked))""")
def reachable_items(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.functions(spark, folder)
    links = old.where("profiled").select((F.col("fid") + 1).alias("new_fid"))
    return overlap.reachable_items(old, new, links).select("fid", "path")


def _projection(spark: SparkSession, folder: str):
    old, new, _, _, func_map = _sides(spark, folder)
    seed = keep(blocks.link_blocks_by_hash(func_map, old, new))
    dead = seed.where("old_bid = 0").withColumn("new_bid", F.lit(-1).cast("bigint"))
    explicit = seed.where("old_bid <> 0").unionByName(dead)
    same = old.select(F.col("fid").alias("old_fid"), F.col("bid").alias("old_bid")).join(func_map, "old_fid").withColumn("new_bid", F.col("old_bid"))
    counts = old.select(F.col("fid").alias("old_fid"), F.col("bid").alias("old_bid"), F.col("cnt").alias("count"))
    size = new.groupBy(F.col("fid").alias("new_fid")).agg(F.count("*").alias("blocks"))
    return counts, explicit, [same], size


@query("project_counts", f"""
  with {HASHED},
  ex as (select old_fid, old_bid, new_fid, case when old_bid=0 then -1 else new_bid end new_bid, 0 as rule from seed),
  sm as (select old_fid, bid old_bid, new_fid, bid new_bid, 1 as rule from fmap join old_n on fid=old_fid where (old_fid,bid) not in (select (old_fid,old_bid) from ex)),
  a as (select * from ex union all select * from sm),
  sz as (select fid new_fid, count(*) blocks from new_n group by 1),
  ok as (select a.* from a join sz using (new_fid) where new_bid<>-1 and new_bid<blocks),
  f as (select * exclude rn from (select *, row_number() over (partition by new_fid,new_bid order by rule, old_fid, old_bid) rn from ok) where rn=1)
  select f.*, cnt count from f join old_n on fid=old_fid and bid=old_bid""")
def project_counts(spark: SparkSession, folder: str) -> DataFrame:
    return project.project_counts(*_projection(spark, folder))


def _greedy(rounds: int) -> str:
    """Rounds of the links that are first at both ends; the last round must find nothing."""
    parts, rest = [], "ok"
    for k in range(rounds):
        parts.append(f"""
  t{k} as materialized (select *, min((rule,old_fid,old_bid)) over (partition by new_fid,new_bid) a,
    min((rule,new_fid,new_bid)) over (partition by old_fid,old_bid) b from {rest}),
  w{k} as materialized (select new_fid, new_bid, rule, old_fid, old_bid from t{k} where a=(rule,old_fid,old_bid) and b=(rule,new_fid,new_bid)),
  r{k} as materialized (select new_fid, new_bid, rule, old_fid, old_bid from {rest} x
    where not exists (select 1 from w{k} w where w.new_fid=x.new_fid and w.new_bid=x.new_bid)
      and not exists (select 1 from w{k} w where w.old_fid=x.old_fid and w.old_bid=x.old_bid))""")
        rest = f"r{k}"
    won = " union all ".join(f"select * from w{k}" for k in range(rounds))
    return f"{','.join(parts)}, f as ({won} union all select -1, -1, -1, -1, -1 from {rest})"


@query("project_counts_unique", f"""
  with {HASHED},
  near as (select old_fid, o.bid old_bid, new_fid, n.bid new_bid, 1 as rule from fmap join old_n o on o.fid=old_fid join new_n n on n.fid=new_fid
    where n.bid between o.bid and o.bid+1 and (old_fid,o.bid) not in (select (old_fid,old_bid) from seed)),
  sz as (select fid new_fid, count(*) blocks from new_n group by 1),
  ok as (select distinct new_fid, new_bid, rule, old_fid, old_bid from (select old_fid, old_bid, new_fid, new_bid, 0 as rule from seed union all
    select * from near) join sz using (new_fid) where new_bid<blocks),
  {_greedy(24)}
  select f.*, cnt count from f left join old_n on fid=old_fid and bid=old_bid""")
def project_counts_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Each old block once: by hash, else on the block of its own or the next number."""
    old, new, _, _, func_map = _sides(spark, folder)
    seed = keep(blocks.link_blocks_by_hash(func_map, old, new))
    bids = lambda side, s: side.select(F.col("fid").alias(f"{s}_fid"), F.col("bid").alias(f"{s}_bid"))
    near = func_map.join(bids(old, "old"), "old_fid").join(bids(new, "new"), "new_fid").where("new_bid between old_bid and old_bid + 1").select(*seed.columns)
    counts = old.select(F.col("fid").alias("old_fid"), F.col("bid").alias("old_bid"), F.col("cnt").alias("count"))
    size = new.groupBy(F.col("fid").alias("new_fid")).agg(F.count("*").alias("blocks"))
    return project.project_counts(counts, seed, [near], size, unique=True)


CROSS = f"""{WIDE},
  oe as (select fid old_fid, bid src_bid, next_bid dst_bid, cnt from old_n where next_bid is not null and cnt<>0),
  oc as (select * from oe join wide w on w.old_fid=oe.old_fid and w.old_bid=oe.src_bid),
  ic as (select * from oe join wide w on w.old_fid=oe.old_fid and w.old_bid=oe.dst_bid)"""


def _cross(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    bb_map, _, _ = _wide(spark, folder)
    old, new, _, _, _ = _sides(spark, folder)
    edges = old.where("next_bid is not null").select(
        F.col("fid").alias("old_fid"), F.col("bid").alias("src_bid"), F.col("next_bid").alias("dst_bid"), F.col("cnt").alias("count"), F.col("bid").alias("at"))
    new_edges = new.where("next_bid is not null").select(F.col("fid").alias("new_fid"), F.col("bid").alias("new_src"), F.col("next_bid").alias("new_dst"))
    return project.cross_projection(edges, bb_map, new_edges)


@query("cross_edge_weights", f"""
  with {CROSS},
  b as (select s.new_fid, s.new_bid new_src, d.new_bid new_dst, e.cnt, e.old_fid, e.src_bid from oe e join wide s on s.old_fid=e.old_fid and s.old_bid=e.src_bid
        join wide d on d.old_fid=e.old_fid and d.old_bid=e.dst_bid and d.new_fid=s.new_fid
        join new_n n on n.fid=s.new_fid and n.bid=s.new_bid and n.next_bid=d.new_bid)
  select new_fid, new_src, new_dst, cnt weight from (select *, row_number() over (partition by new_fid,new_src,new_dst order by old_fid desc, src_bid desc) rn from b) where rn=1""")
def cross_edge_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _cross(spark, folder)[0]


@query("cross_projection", f"""
  with {CROSS},
  u as (select new_fid, new_bid, cnt o, 0 i from oc union all select new_fid, new_bid, 0, cnt from ic)
  select new_fid, new_bid, sum(o)::bigint out_weight, sum(i)::bigint in_weight from u group by 1,2""")
def cross_projection(spark: SparkSession, folder: str) -> DataFrame:
    return _cross(spark, folder)[1]


def _fall(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cfg = fx.cfg(spark, folder)
    gap = F.when(F.col("hash") % 4 == 0, 8).otherwise(16)
    nodes = cfg.select("fid", "bid", F.col("start_off").alias("start_address"), (F.col("start_off") + gap).alias("end_address"))
    edges = cfg.where("next_bid is not null").select(
        F.col("fid").alias("src_fid"), F.col("bid").alias("src_bid"), F.col("fid").alias("dst_fid"), F.col("next_bid").alias("dst_bid"), F.col("cnt").alias("count"))
    return edges, nodes


@query("fallthrough_edges", f"""
  with {fx.CFG} select fid src_fid, bid src_bid, fid dst_fid, next_bid dst_bid, cnt count from cfg where next_bid is not null and hash%4<>0""")
def fallthrough_edges(spark: SparkSession, folder: str) -> DataFrame:
    return project.fall_through_edges(*_fall(spark, folder))


@query("fallthrough_score", f"with {fx.CFG} select sum(cnt)::bigint score from cfg where next_bid is not null and hash%4<>0")
def fallthrough_score(spark: SparkSession, folder: str) -> DataFrame:
    return project.fall_through_score(*_fall(spark, folder))


@query("link_methods", f"""
  with {fx.FUNCTIONS},
  e as (select o.fid old_fid, min(n.fid) new_fid from old_f o join new_f n on n.func=o.func group by 1),
  p as (select o.fid old_fid, min(n.fid) new_fid from old_f o join new_f n on n.path=o.path and n.parameters=o.parameters group by 1)
  select * from (select *, 'exact' as method from e union all select *, 'path' from p where old_fid not in (select old_fid from e))""")
def link_methods(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.functions(spark, folder)
    def first(on: list[str]) -> DataFrame:
        # one partner a key, so equal functions form no pairs
        partner = new.groupBy(*on).agg(F.min("fid").alias("new_fid"))
        pairs = old.select(F.col("fid").alias("old_fid"), *on).join(partner, on)
        return pairs.groupBy("old_fid").agg(F.min("new_fid").alias("new_fid"))

    return project.link_methods({"exact": first(["func"]), "path": first(["path", "parameters"])})


@query("name_alias", f"""
  with {fx.FUNCTIONS}, al as (select func old_func, concat(min(basename),'_x') new_func from old_f where profiled group by 1)
  select fid, func, coalesce(new_func,func) lookup from funcs left join al on old_func=func""")
def name_alias(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.functions(spark, folder)
    aliases = old.where("profiled").groupBy(F.col("func").alias("old_func")).agg(F.concat(F.min("basename"), F.lit("_x")).alias("new_func"))
    return project.resolve_names(old.unionByName(new).select("fid", "func"), aliases)


@query("nearest_name", f"""
  with {fx.FUNCTIONS},
  p as (select o.func old_func, n.func new_func, case when o.func like '%)' then n.func else split_part(n.func,'(',1) end c from old_f o join new_f n on o.basename=n.basename),
  d as (select old_func, new_func, levenshtein(old_func,c) distance, 2*levenshtein(old_func,c)-length(old_func)-length(c) tie from p)
  select old_func, new_func, distance from (select *, row_number() over (partition by old_func order by distance, tie, new_func) rn from d) where rn=1""")
def nearest_name(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.functions(spark, folder)
    side = lambda f: f.select("func", file_name(F.col("path")).alias("file")).distinct()
    near = project.nearest_name(side(old), side(new), ["file"])
    return near.withColumn("distance", F.col("distance").cast("bigint"))


@query("link_versions")
def link_whole_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All steps, every loop until dry, on documents as programs: 20 lines form a function, 5 a block, a line is an instruction."""
    old_lines, new_lines = fx.edited_lines(spark, folder)

    def version(lines: DataFrame) -> Version:
        doc = F.element_at(F.split("path", "/"), -1).cast("bigint")
        word = F.regexp_replace(F.substring_index("code", " ", 1), r"[^A-Za-z?]", "")
        items_of = settle(lines.select(
            (doc * 100000 + F.expr("line div 20") * 100).alias("fid"), F.expr("(line % 20) div 5").alias("bid"), "path", "line",
            (doc * 100000 + F.col("line")).alias("address"), F.concat(F.lower(word), F.lit("\t"), "code").alias("instruction"), "code"))
        hashed = items_of.groupBy("fid", "bid").agg(
            F.min("address").alias("start_address"), (F.max("address") + 1).alias("end_address"), F.sum(F.xxhash64("code") % 1000000007).alias("hash"),
            F.count("*").alias("insns"))
        nodes = settle(hashed.withColumn("count", F.col("insns")))
        ends = nodes.select(F.col("fid").alias("dst_fid"), F.col("bid").alias("dst_bid"))
        edges = nodes.select(F.col("fid").alias("src_fid"), F.col("bid").alias("src_bid"), F.col("fid").alias("dst_fid"), (F.col("bid") + 1).alias("dst_bid"))
        firsts = items_of.groupBy("fid", "path").agg(F.min("line").alias("line"), F.min_by("code", "line").alias("code"))
        name = F.col("code")
        info = settle(firsts.select("fid", F.concat(name, F.lit("#"), F.col("fid").cast("string")).alias("func"),
                                    F.element_at(F.split("path", "/"), -2).alias("namespace"), name.alias("basename"), F.lit("()").alias("parameters"),
                                    F.lit("").alias("extension"), F.lit("1").alias("chunk"), "path", "line"))
        functions = info.select("fid", "func", F.lit(1).cast("bigint").alias("count"))
        return Version(functions, info, nodes, settle(edges.join(ends, ["dst_fid", "dst_bid"], "left_semi")),
                       items_of.drop("code"), settle(lines.select("path", "line", "code")))

    old, new = version(old_lines), version(new_lines)
    links = link_versions(old, new, old.functions.select("fid", "func"))
    return links.blocks.select("old_fid", "old_bid", "new_fid", "new_bid")
