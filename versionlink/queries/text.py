"""Queries on text transforms, similarity measures, sources and sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from versionlink import sinks
from versionlink.functions import similarity as sim, text
from versionlink.operators.asof import asof_backward, asof_inside
from versionlink.operators.ranges import contain_join
from versionlink.operators.ranks import positions
from versionlink.plans.paths import link_paths_by_name, replace_with_path
from versionlink.plans.project import sample_shares
from versionlink.queries import fixtures as fx
from versionlink.queries.registry import query
from versionlink.session import shared_folder
from versionlink.sources import links, logs
from versionlink.sources.files import split_sources
from versionlink.sources.listing import read_instructions


def scratch(spark: SparkSession) -> str:
    return shared_folder(spark, "text")


EDIT = "case when greatest(length({a}),length({b}))=0 then 1.0 else 1.0-levenshtein({a},{b})::double/greatest(length({a}),length({b})) end"


def edit(a: str, b: str) -> str:
    return "(" + EDIT.format(a=a, b=b) + ")"


NAMES = "select distinct p_name n, p_brand b, p_type t from part"


@query("name_similarity", f"""
  with v as ({NAMES}), w as (select n, b, t, lead(n) over (order by n,b,t) m, lead(b) over (order by n,b,t) c from v)
  select n, b, t, round({edit("n", "m")},10) similarity, -abs(length(n)-length(m)) closeness,
         case when greatest(length(n),length(m))=0 then 0 else round(levenshtein(n,m)::double/greatest(length(n),length(m)),10) end fraction,
         ((length(n)+length(m)-levenshtein(n,m))//2)::bigint shared
  from w where m is not null""")
def name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct part name against the next one in name order."""
    names = fx.table(spark, folder, "part").select(
        F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("t")).distinct()
    # the next name is the one at the next position of the whole order
    ranked = positions(names.withColumn("all", F.lit(0)), ["all"], ["n", "b", "t"], "at", task_rows=0)  # ranked over many tasks
    after = ranked.select((F.col("at") - 1).alias("at"), F.col("n").alias("m"))
    return ranked.join(after, "at").select(
        "n", "b", "t", F.round(sim.edit_similarity("n", "m"), 10).alias("similarity"),
        sim.length_closeness("n", "m").alias("closeness"),
        F.round(sim.edit_fraction("n", "m"), 10).alias("fraction"), sim.overlap_length("n", "m").alias("shared"),
    )


SUFFIX = """
  suffixed as (
    select p_partkey k, concat(p_size,'.',p_name,'.',p_partkey%7) a,
           concat(p_size%9,'.',p_type, case when p_size%3=0 then '.llvm.12' else '' end) b from part)"""


@query("suffix_distance", f"""
  with {SUFFIX},
  tok as (select k, unnest(range(1, greatest(len(string_split(a,'.')),len(string_split(b,'.')))+1)) i,
                 string_split(a,'.') x, string_split(b,'.') y from suffixed),
  cmp as (select k, i, x[i] xi, y[i] yi,
                 case when regexp_full_match(x[i],'[0-9]+') then x[i]::double end nx,
                 case when regexp_full_match(y[i],'[0-9]+') then y[i]::double end ny from tok),
  st as (select k, i,
           case when xi is null or yi is null then coalesce(nx,ny) else abs(nx-ny) end num,
           case when (case when xi is null or yi is null then coalesce(nx,ny) else abs(nx-ny) end) is not null then 0.0
                when xi is null or yi is null then 1.0 when xi<>yi then 2.0 else 0.0 end cost from cmp),
  w as (select k, cost, num, count(num) over (partition by k order by i desc rows between unbounded preceding and 1 preceding) after from st)
  select k, round(sum(cost)+coalesce(sum(num*pow(100,coalesce(after,0))),0)*1e-12,9) distance from w group by k""")
def suffix_distance(spark: SparkSession, folder: str) -> DataFrame:
    part = fx.table(spark, folder, "part")
    s = lambda c: F.col(c).cast("string")
    tail = F.when(F.col("p_size") % 3 == 0, ".llvm.12").otherwise("")
    a = F.concat(s("p_size"), F.lit("."), "p_name", F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    b = F.concat((F.col("p_size") % 9).cast("string"), F.lit("."), "p_type", tail)
    return part.select(F.col("p_partkey").alias("k"), F.round(sim.suffix_distance(a, b), 9).alias("distance"))


@query("call_distance", """
  with v as (select p_partkey k, concat(p_type, case when p_size%2=0 then '()' else '' end) o,
                    concat(p_name,'(',p_brand,')') n from part),
  c as (select k, o, case when o like '%)' then n else split_part(n,'(',1) end n from v)
  select k, levenshtein(o,n)::bigint distance, (2*levenshtein(o,n)-length(o)-length(n))::bigint tie from c""")
def call_distance(spark: SparkSession, folder: str) -> DataFrame:
    part = fx.table(spark, folder, "part")
    old = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "()").otherwise(""))
    new = F.concat("p_name", F.lit("("), "p_brand", F.lit(")"))
    pairs = part.select(F.col("p_partkey").alias("k"), old.alias("o"), new.alias("n"))
    near = pairs.select("k", sim.call_distance("o", "n").alias("d"))
    return near.select("k", F.col("d.distance").cast("bigint").alias("distance"), F.col("d.tie").cast("bigint").alias("tie"))


@query("name_distance", f"""
  with v as (select p_partkey k, p_type c1, p_name b1, p_brand q1, lower(p_type) c2, concat(p_name,'x') b2, concat('Brand',p_size) q2 from part),
  d as (select k, (levenshtein(c1,c2)::double/greatest(length(c1),length(c2))+levenshtein(b1,b2)::double/greatest(length(b1),length(b2)))/2 n,
               levenshtein(q1,q2)::double/greatest(length(q1),length(q2)) p from v)
  select k, round(case when n>0.5 then 1.0 else n end,10) name_d, round(case when n>0.5 then (p+1.0)/2 else p end,10) params_d from d""")
def name_distance(spark: SparkSession, folder: str) -> DataFrame:
    part = fx.table(spark, folder, "part").select(F.col("p_partkey").alias("k"), "p_type", "p_name", "p_brand", "p_size")
    none = F.lit("")
    d = sim.name_distance("p_type", F.lower("p_type"), "p_name", F.concat("p_name", F.lit("x")),
                          "p_brand", F.concat(F.lit("Brand"), F.col("p_size").cast("string")), none, none)
    near = part.select("k", d.alias("d"))
    return near.select("k", F.round("d.name", 10).alias("name_d"), F.round("d.params", 10).alias("params_d"))


@query("lines_without_comments", r"""
  with raw as (select doc_id, regexp_replace(replace(replace(text,'. ',' /* '),', ',' */ '),'[^\x00-\x7F]','?','g') text from documents),
  marked as (select doc_id, list_transform(string_split_regex(text,'\r\n|\r|\n'),
               lambda x, i: concat(regexp_replace(x,'\s+$',''),' //',i)) l from raw),
  clean as (select doc_id, unnest(string_split(regexp_replace(array_to_string(l,chr(10)),'/\*.*?\*/','','gs'),chr(10))) v from marked)
  select doc_id, regexp_extract(v,'^(.*) //(\d+)$',2,'s')::bigint line, regexp_extract(v,'^(.*) //(\d+)$',1,'s') code
  from clean where not regexp_matches(v,'^[ \t]+//\d+$')""")
def lines_without_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents with sentence marks turned into comment marks."""
    marks = F.replace(F.replace("text", F.lit(". "), F.lit(" /* ")), F.lit(", "), F.lit(" */ "))
    texts = fx.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.regexp_replace(marks, fx.ASCII, "?").alias("text"))
    return split_sources(texts).select(F.col("path").cast("bigint").alias("doc_id"), "line", "code")


@query("line_tokens", f"""
  with {fx.LINES},
  t as (select doc_id, line, regexp_replace(trim(regexp_replace(regexp_replace(code,'//[^\\n]*',''),'\\s+',' ','g')),'^\\s+|\\s+$','','g') c from lines),
  w as (select doc_id, line, unnest(string_split(c,' ')) word, generate_subscripts(string_split(c,' '),1) p from t)
  select doc_id, line, word, row_number() over (partition by doc_id,line,word order by p) k, (p-1)::bigint "at" from w""")
def line_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.lines(spark, folder).select("doc_id", "line", F.posexplode(text.words(text.without_line_comment(F.col("code")))).alias("at", "word"))
    w = Window.partitionBy("doc_id", "line", "word").orderBy("at")
    return rows.select("doc_id", "line", "word", F.row_number().over(w).cast("bigint").alias("k"), F.col("at").cast("bigint").alias("at"))


@query("line_occurrences", f"""
  with {fx.LINES}
  select path, code, line, rank() over (partition by path, code order by line) k
  from lines where not regexp_matches(code,'^\\s*#|^\\s*[\\{{\\}}]$')""")
def line_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.lines(spark, folder).where(text.is_linkable(F.col("code"))).select("path", "code", "line")
    return positions(rows, ["path", "code"], ["line"], "k").withColumn("k", F.col("k").cast("bigint"))


@query("path_levels", """
  with p as (select page_id, list_reverse(string_split(url,'/')) l from pages)
  select page_id, unnest(l) component, (generate_subscripts(l,1)-1)::bigint level from p""")
def path_levels(spark: SparkSession, folder: str) -> DataFrame:
    pages = fx.table(spark, folder, "pages")
    return pages.select("page_id", F.posexplode(text.levels(F.col("url"))).alias("level", "component")).select(
        "page_id", "component", F.col("level").cast("bigint").alias("level"))


@query("path_file_name", f"with {fx.PAGE_PATHS} select page_id, regexp_replace(path,'^.*/','') file from paths")
def path_file_name(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return fx.table(spark, folder, "pages").select("page_id", text.file_name(bare).alias("file"))


@query("jump_targets", r"""
  with i as (select l_orderkey k, l_linenumber n, l_partkey p,
    concat(case when l_returnflag='A' then 'jmp' when l_returnflag='N' then 'je' else 'mov' end, chr(9),
           '0x', lower(to_hex(l_partkey)), ' <f', l_suppkey, '+0x', lower(to_hex(l_suppkey)), '>') t from lineitem),
  s as (select k, n, p, split_part(t,chr(9),1) opcode, regexp_replace(split_part(t,chr(9),2),'0x[0-9a-f]+\s<','<') operand from i)
  select k, n, p, opcode, operand,
    case when opcode like 'j%' then regexp_extract(operand,'<(.+)\+0x([0-9a-f]+)>',1) end target,
    case when opcode like 'j%' then cast(concat('0x',regexp_extract(operand,'<(.+)\+0x([0-9a-f]+)>',2)) as bigint) end off from s""")
def jump_targets(spark: SparkSession, folder: str) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c))
    op = F.when(F.col("l_returnflag") == "A", "jmp").when(F.col("l_returnflag") == "N", "je").otherwise("mov")
    t = F.concat(op, F.lit("\t0x"), hexed("l_partkey"), F.lit(" <f"), F.col("l_suppkey").cast("string"), F.lit("+0x"), hexed("l_suppkey"), F.lit(">"))
    rows = fx.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), t.alias("t"))
    rows = rows.select("k", "n", "p", text.opcode(F.col("t")).alias("opcode"), text.operand(F.col("t")).alias("operand"))
    return rows.select("*", text.jump_name(F.col("opcode"), F.col("operand")).alias("target"),
                       text.jump_offset(F.col("opcode"), F.col("operand")).alias("off"))


@query("asof_marker", """
  with m as (select ts, event_id, value from events where event_type='error')
  select e.event_id, m.event_id marker, m.value marker_value
  from events e asof left join m on e.ts >= m.ts""")
def asof_marker(spark: SparkSession, folder: str) -> DataFrame:
    events = fx.table(spark, folder, "events")
    marks = events.where("event_type = 'error'").select("ts", F.col("event_id").alias("marker"), F.col("value").alias("marker_value"))
    return asof_backward(events.select("event_id", "ts"), marks, ["ts"], ["marker", "marker_value"]).drop("ts")


RANGES = """
  r as (select o_orderkey*10 st, o_orderkey*10+1+o_orderkey%7 en, o_orderkey fid from orders),
  a as (select distinct l_orderkey*10+l_linenumber address from lineitem)"""


def _ranges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    spans = fx.table(spark, folder, "orders").select(
        (key * 10).alias("st"), (key * 10 + 1 + key % 7).alias("en"), key.alias("fid"))
    points = fx.table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("address"))
    return points.distinct(), spans


@query("address_in_block", f"with {RANGES} select address, fid from a join r on address>=st and address<en")
def address_in_block(spark: SparkSession, folder: str) -> DataFrame:
    points, spans = _ranges(spark, folder)
    return asof_inside(points, spans, "address", "st", "en", ["fid"]).select("address", "fid")


@query("address_in_range", f"with {RANGES} select address, fid from a join r on address>=st and address<en")
def address_in_range(spark: SparkSession, folder: str) -> DataFrame:
    points, spans = _ranges(spark, folder)
    top = points.agg(F.max("address")).first()[0] or 1
    return contain_join(points, spans, [], "address", "st", "en", top).select("address", "fid")


PATH_BEST = f"""
  cand as (select o.path old_path, n.path new_path, {edit("o.path", "n.path")} s
           from old_p o join new_p n on regexp_replace(o.path,'^.*/','')=regexp_replace(n.path,'^.*/','')),
  best as (select old_path, min(new_path) new_path from cand c
           where s=(select max(s) from cand d where d.old_path=c.old_path) group by 1)"""


@query("path_link_by_name", f"with {fx.PAGE_PATHS}, {PATH_BEST} select * from best")
def path_link_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return link_paths_by_name(*fx.page_paths(spark, folder))


@query("path_replace", f"""
  with {fx.PAGE_PATHS}, {PATH_BEST}
  select p.page_id, coalesce(new_path,p.path) path from paths p left join best on p.path=old_path where page_id%2=0""")
def path_replace(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    old = fx.table(spark, folder, "pages").where(F.col("page_id") % 2 == 0).select("page_id", bare.alias("file"))
    return replace_with_path(old, "file", fx.page_paths(spark, folder)[1])


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cfg = fx.cfg(spark, folder)
    count = F.when(F.col("cnt") % 10 == 0, F.lit(-1)).otherwise(F.col("cnt"))
    base = F.col("fid") * 1000
    nodes = cfg.select("fid", "bid", "hash", count.alias("count"), "next_bid").select(
        base.alias("fid"), "bid", (base + F.col("bid") * 16).alias("start_address"),
        (base + F.col("bid") * 16 + 16).alias("end_address"), (-F.col("hash")).alias("hash"), (F.col("bid") + 3).alias("insns"), "count")
    edges = cfg.where("next_bid is not null").select(
        base.alias("src_fid"), F.col("bid").alias("src_bid"), base.alias("dst_fid"), F.col("next_bid").alias("dst_bid"), F.col("cnt").alias("count"))
    orders = fx.table(spark, folder, "orders")
    number = F.col("o_orderkey").cast("string")
    alias = F.explode(F.array(F.concat(F.lit("f"), number), F.concat(F.lit("f"), number, F.lit("/2"))))
    functions = orders.select((F.col("o_orderkey") * 1000).alias("fid"), alias.alias("func"), F.col("o_custkey").alias("count"))
    return functions, nodes, edges


def _written(spark: SparkSession, folder: str) -> str:
    path = scratch(spark)
    sinks.write_lines(sinks.graph_lines(*_graph(spark, folder)), path)
    return path


@query("log_nodes_round_trip", f"""
  with {fx.CFG}
  select fid*1000 fid, bid, fid*1000+bid*16 start_address, fid*1000+bid*16+16 end_address, (-hash)::bigint hash,
         bid+3 insns, case when cnt%10=0 then -1 else cnt end count from cfg""")
def log_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return logs.read_nodes(spark, _written(spark, folder))


@query("log_edges_round_trip", f"""
  with {fx.CFG} select fid*1000 src_fid, bid src_bid, fid*1000 dst_fid, next_bid dst_bid from cfg where next_bid is not null""")
def log_edges(spark: SparkSession, folder: str) -> DataFrame:
    return logs.read_edges(spark, _written(spark, folder))


@query("log_functions_round_trip", """
  select o_orderkey*1000 fid, unnest([concat('f',o_orderkey),concat('f',o_orderkey,'/2')]) func, o_custkey count from orders""")
def log_functions(spark: SparkSession, folder: str) -> DataFrame:
    return logs.read_functions(spark, _written(spark, folder))


INFO = f"""
  info as (select concat(replace(func,'#','-'), case when fid%3=0 then concat('/',fid%5) else '' end) func, namespace, basename, replace(parameters,'#','-') parameters, extension,
                  path, line, fid from funcs)"""


@query("log_info_round_trip", f"""
  with {fx.FUNCTIONS}, {INFO}
  select func, namespace, basename, parameters, extension, path file, line, fid "column",
         cast(fid as varchar) id, cast(fid*7 as varchar) hash, '4' nblocks,
         case when contains(func,'/') then regexp_extract(func,'^[^/]*/(.*)$',1) else '1' end chunk,
         dense_rank() over (partition by path order by line)::integer rank
  from info""")
def log_info(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.functions(spark, folder)
    fid = F.col("fid")
    chunk = F.when(fid % 3 == 0, F.concat(F.lit("/"), (fid % 5).cast("string"))).otherwise("")
    dotted = F.concat(F.lit("x/./../"), "path")
    plain = lambda c: F.replace(c, F.lit("#"), F.lit("-"))  # the mark splits fields
    info = old.unionByName(new).select(
        F.concat(plain("func"), chunk).alias("func"), "namespace", "basename", plain("parameters").alias("parameters"), "extension",
        dotted.alias("file"), "line", fid.alias("column"), fid.cast("string").alias("id"),
        (fid * 7).cast("string").alias("hash"), F.lit("4").alias("nblocks"))
    path = scratch(spark)
    sinks.write_lines(sinks.info_lines(info), path)
    return logs.with_line_rank(logs.read_function_info(spark, path))


@query("profiled_names", "select distinct concat(s_name) func from supplier")
def profiled_names(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    rows = fx.table(spark, folder, "supplier").select(
        F.explode(F.array(F.concat(F.lit("  - name:   '"), "s_name", F.lit("'")), F.lit("    fid: 3"))).alias("value"))
    sinks.write_lines(rows, path)
    return logs.read_profiled_names(spark, path)


@query("listing_items", """
  with o as (select o_orderkey, o_custkey from orders),
  l as (select l_orderkey, l_linenumber, min(l_partkey) p from lineitem group by 1,2)
  select l_orderkey*1000 fid, (l_linenumber-1)::bigint bid, concat('s',o_custkey,'.c') path, l_orderkey line,
         l_orderkey*1000+(l_linenumber-1)*16+4 address, concat('mov',chr(9),p) instruction
  from l join o on o_orderkey=l_orderkey""")
def listing_items(spark: SparkSession, folder: str) -> DataFrame:
    """A listing written from orders (positions) and line items (instructions), read back in order."""
    orders = fx.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    items = fx.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    address = F.col("k") * 1000 + (F.col("l_linenumber") - 1) * 16 + 4
    code = F.concat(F.lit("  "), F.lower(F.hex(address)), F.lit(": \tmov\t"), F.col("p").cast("string"))
    mark = F.concat(F.lit("; obj/x/../s"), F.col("o_custkey").cast("string"), F.lit(".c:"), F.col("k").cast("string"))
    rows = orders.select("k", F.lit(0).alias("n"), mark.alias("value")).unionByName(
        items.join(orders.select("k"), "k").select("k", F.col("l_linenumber").alias("n"), code.alias("value")))
    path = scratch(spark)
    rows.repartitionByRange("k", "n").sortWithinPartitions("k", "n").select("value").write.text(path)
    nodes = items.join(orders.select("k"), "k").select(
        (F.col("k") * 1000).alias("fid"), (F.col("l_linenumber") - 1).cast("bigint").alias("bid"),
        (address - 4).alias("start_address"), (address + 12).alias("end_address"))
    return read_instructions(spark, path, nodes)


@query("function_map_reader", """
  select concat('o',l_orderkey) old_func, concat('n',max(l_linenumber),',x') new_func from lineitem group by l_orderkey""")
def function_map_reader(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    rows = fx.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").repartitionByRange("l_orderkey").sortWithinPartitions(
        "l_orderkey", "l_linenumber")
    line = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(",n"), F.col("l_linenumber").cast("string"), F.lit(",x"))
    rows.select(line.alias("value")).write.text(path)
    return links.read_function_map(spark, path)


@query("block_map_with_tombstones", f"""
  with {fx.CFG},
  m as (select concat('f',fid) old_func, bid old_bid, case when hash%5=0 then -1 else coalesce(next_bid,0) end new_bid from cfg)
  select * from m""")
def block_map_with_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    cfg = fx.cfg(spark, folder)
    name = F.concat(F.lit("f"), F.col("fid").cast("string"))
    text_of = lambda c: F.col(c).cast("string")
    blocks, cross = scratch(spark), scratch(spark)
    to = F.coalesce(text_of("next_bid"), F.lit("0"))
    sinks.write_lines(cfg.select(F.concat_ws(",", name, text_of("bid"), to).alias("value")), blocks)
    bad = F.when(F.col("hash") % 5 == 0, F.concat_ws(",", name, text_of("bid"), name, text_of("bid"))).otherwise(
        F.concat_ws(",", name, F.lit("?"), name, text_of("bid")))
    sinks.write_lines(cfg.select(bad.alias("value")), cross)
    names = cfg.select(name.alias("func")).distinct()
    links_read, _ = links.read_cross_map(spark, cross, names, names)
    return links.with_tombstones(links.read_block_map(spark, blocks), links_read)


@query("function_places", """
  select concat('f',p_partkey) func, concat(p_type,'.c') path, p_size::bigint line from part""")
def function_places(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    row = F.concat(F.col("p_type"), F.lit(".c,"), F.col("p_size").cast("string"), F.lit(",f"), F.col("p_partkey").cast("string"))
    bad = F.concat(F.lit("x,?,f"), F.col("p_partkey").cast("string"))
    sinks.write_lines(fx.table(spark, folder, "part").select(F.explode(F.array(row, bad)).alias("value")), path)
    return links.read_function_places(spark, path)


@query("skip_list", f"""
  with {fx.FUNCTIONS} select fid, func from funcs where func not in (select concat(p_name,'::',p_brand) from part where p_size>25)""")
def skip_list(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    part = fx.table(spark, folder, "part")
    sinks.write_lines(part.where("p_size > 25").select(F.concat("p_name", F.lit("::"), "p_brand").alias("value")), path)
    old, new = fx.functions(spark, folder)
    return links.without_skipped(old.unionByName(new).select("fid", "func"), links.read_names(spark, path))


@query("heat_report", f"""
  with {fx.CFG}
  select fid, string_agg(concat(bid,'#',(cnt<10)::int,'#',(cnt%10<>0)::int,'#',cnt),' ' order by bid) blocks, count(*) n
  from cfg group by fid""")
def heat_report(spark: SparkSession, folder: str) -> DataFrame:
    nodes = fx.cfg(spark, folder).select(
        "fid", "bid", F.col("cnt").alias("count"), (F.col("cnt") < 10).alias("cold"), (F.col("cnt") % 10 != 0).alias("has_profile"))
    functions = nodes.groupBy("fid").agg(F.count("*").alias("count")).withColumn("func", F.concat(F.lit("f"), F.col("fid").cast("string")))
    return sinks.heat_report(functions, nodes).select("fid", "blocks", F.col("count").alias("n"))


@query("stale_share", """
  select sum(case when l_returnflag='R' then l_quantity else 0 end)::bigint stale,
         sum(case when l_returnflag='A' then l_quantity else 0 end)::bigint inferred, sum(l_quantity)::bigint total,
         round(100.0*sum(case when l_returnflag in ('A','R') then l_quantity else 0 end)/sum(l_quantity),1)::double percent from lineitem""")
def stale_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.table(spark, folder, "lineitem").select(
        F.col("l_quantity").cast("bigint").alias("count"), (F.col("l_returnflag") == "R").alias("stale"), (F.col("l_returnflag") == "A").alias("inferred"))
    return sample_shares(rows).withColumn("percent", F.col("percent").cast("double"))
