"""Queries that link paths, functions and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from versionlink.operators.assign import Tier, rounds_of_unique_best
from versionlink.operators.bounds import loose_bounds, ranked_bounds, tight_bounds
from versionlink.operators.closest import closest, similar_pairs
from versionlink.plans import function_lines, functions as fn, lines as ln, overlap, paths, project
from versionlink.queries import fixtures as fx
from versionlink.queries.registry import query
from versionlink.queries.text import edit
from versionlink.session import keep, settle

SHARED = """
  oc as (select path, code, rank() over (partition by path, code order by line) k from old_src where not regexp_matches(code,'^\\s*#|^\\s*[\\{\\}]$')),
  nc as (select path, code, rank() over (partition by path, code order by line) k from new_src where not regexp_matches(code,'^\\s*#|^\\s*[\\{\\}]$')),
  shared as (select o.path old_path, n.path new_path, sum(length(o.code))::bigint len from oc o join nc n using (code,k) group by 1,2)"""


@query("shared_line_weight", f"with {fx.SPLIT_LINES}, {SHARED} select * from shared")
def shared_line_weight(spark: SparkSession, folder: str) -> DataFrame:
    return paths.shared_line_weight(*fx.split_lines(spark, folder))


@query("path_link_by_content", f"""
  with {fx.SPLIT_LINES}, {SHARED},
  best as (select *, max(len) over (partition by old_path) a, max(len) over (partition by new_path) b from shared),
  won as (select old_path, new_path, len, count(*) over (partition by old_path) x, count(*) over (partition by new_path) y
          from best where len=a and len=b)
  select old_path, new_path, len from won where x=1 and y=1""")
def path_link_by_content(spark: SparkSession, folder: str) -> DataFrame:
    return paths.link_paths_by_content(*fx.split_lines(spark, folder))


def unique_rounds(pairs: str, left: str, right: str, tiers: list[str], rounds: int, columns: str) -> str:
    """SQL of rounds of unique mutual best pairs, one after the other."""
    ctes, open_pairs = [], pairs
    for i in range(rounds):
        previous = open_pairs
        for j, score in enumerate(tiers):
            ctes.append(f"""t{i}_{j} as materialized (select * exclude (ba,bb) from (
              select *, max({score}) over (partition by {left}) ba, max({score}) over (partition by {right}) bb from {previous})
              where {score}=ba and {score}=bb)""")
            previous = f"t{i}_{j}"
        ctes.append(f"""w{i} as materialized (select * exclude (na,nb) from (
          select *, count(*) over (partition by {left}) na, count(*) over (partition by {right}) nb from {previous}) where na=1 and nb=1)""")
        ctes.append(f"""o{i} as materialized (select * from {open_pairs} p where ({left}) not in (select ({left}) from w{i})
          and ({right}) not in (select ({right}) from w{i}))""")
        open_pairs = f"o{i}"
    won = " union all ".join(f"select {columns} from w{i}" for i in range(rounds))
    return ",\n".join(ctes) + ",\nwon as (" + won + ")"


@query("mutual_best_rounds", f"""
  with {fx.SPLIT_LINES}, {SHARED}, {unique_rounds("shared", "old_path", "new_path", ["len"], 12, "old_path, new_path, len")}
  select * from won""")
def mutual_best_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Paths by shared lines, in rounds until no pair is won."""
    pairs = paths.shared_weight_of_two(*fx.split_lines(spark, folder))
    return rounds_of_unique_best(pairs, ["old_path"], ["new_path"], [Tier("len")])


ROUNDS = 24


def ordered_rounds(pairs: str, rounds: int = ROUNDS) -> str:
    """SQL of rounds of best pairs with name order for ties; ``pairs`` has ``rank`` (1 is best)."""
    order = "old_func, new_func, old_fid, new_fid"
    ctes, open_pairs = [], pairs
    for i in range(rounds):
        ctes.append(f"""b{i} as materialized (select * exclude (ba,bb) from (
          select *, min(rank) over (partition by old_fid) ba, min(rank) over (partition by new_fid) bb from {open_pairs}) where rank=ba and rank=bb)""")
        ctes.append(f"""f{i} as materialized (select * exclude rn from (
          select *, row_number() over (partition by old_fid order by {order}) rn from b{i}) where rn=1)""")
        ctes.append(f"""w{i} as materialized (select * exclude rn from (
          select *, row_number() over (partition by new_fid order by {order}) rn from f{i}) where rn=1)""")
        ctes.append(f"""o{i} as materialized (select * from {open_pairs} where old_fid not in (select old_fid from w{i})
          and new_fid not in (select new_fid from w{i}))""")
        open_pairs = f"o{i}"
    won = " union all ".join(f"select old_fid, old_func, new_fid, new_func from w{i}" for i in range(rounds))
    return ",\n".join(ctes) + ",\nwon as (" + won + ")"


def level_sql(level: fn.Level) -> str:
    file = lambda s: f"regexp_replace({s}.path,'^.*/','')"
    part = lambda s, c: file(s) if c == "file" else f"{s}.{c}"
    on = " and ".join(f"{part('o', c)}={part('n', c)}" for c in level.block) or "true"
    scores = []
    for c in level.score:
        if c == "one":
            scores.append("1")
        elif c == "len":
            scores.append("-abs(length(o.func)-length(n.func))")
        elif c == fn.NAME:
            scores.append(f"{edit('o.namespace', 'n.namespace')}+{edit('o.basename', 'n.basename')}")
        else:
            scores.append(edit(f"o.{c}", f"n.{c}"))
    where = []
    if level.profiled:
        where.append("o.func in (select func from old_f where profiled)")
    if level.same_cold:
        where.append("contains(o.extension,'cold')=contains(n.extension,'cold')")
    order = ", ".join(f"{s} desc" for s in scores)
    return f"""with {fx.FUNCTIONS},
      pairs as materialized (select o.fid old_fid, o.func old_func, n.fid new_fid, n.func new_func, rank() over (order by {order}) rank
                from old_f o join new_f n on {on} where {' and '.join(where) or 'true'}),
      {ordered_rounds('pairs')} select * from won"""


def _functions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = fx.functions(spark, folder)
    return old.drop("profiled"), new.drop("profiled"), old.where("profiled").select("fid", "func")


def _level_query(level: fn.Level):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        old, new, profiled = _functions(spark, folder)
        return fn.link_level(old, new, profiled, level, aliases=False)

    query(f"function_level_{level.name}", level_sql(level))(run)


for _level in [*fn.LEVELS, *fn.ROUTES[0], *fn.ROUTES[1]]:
    _level_query(_level)


@query("function_cascade")
def function_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """One pass over all levels."""
    return fn.link_functions_once(*_functions(spark, folder))


@query("function_links")
def function_links(spark: SparkSession, folder: str) -> DataFrame:
    """All levels and passes; what is left is linked by name alone."""
    return fn.link_functions(*_functions(spark, folder))


CALLS = f"""
  pairs as materialized (
    select old_fid, old_func, new_fid, new_func, rank() over (order by d, 2*d-length(old_func)-length(c), old_func desc, new_func desc) rank
    from (select *, levenshtein(old_func,c) d from (
      select o.fid old_fid, o.func old_func, n.fid new_fid, n.func new_func,
             case when o.func like '%)' then n.func else split_part(n.func,'(',1) end c
      from old_f o join new_f n on o.basename=n.basename)))"""


@query("nearest_calls_in_file", f"with {fx.FUNCTIONS}, {CALLS}, {ordered_rounds('pairs')} select * from won")
def nearest_calls_in_file(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _ = _functions(spark, folder)
    side = lambda f: f.withColumn("file", F.col("basename")).withColumn("blocks", F.lit(1))
    return project.nearest_calls_in_file(side(old), side(new))


@query("nearest_calls_of_same_size", f"with {fx.FUNCTIONS}, {CALLS.replace('o.basename=n.basename', 'o.basename=n.basename and o.line%4=n.line%4')}, {ordered_rounds('pairs')} select * from won")
def nearest_calls_of_same_size(spark: SparkSession, folder: str) -> DataFrame:
    """As ``nearest_calls_in_file``, but only functions of as many blocks meet."""
    old, new, _ = _functions(spark, folder)
    side = lambda f: f.withColumn("file", F.col("basename")).withColumn("blocks", F.col("line") % 4)
    return project.nearest_calls_in_file(side(old), side(new), same_size=True)


def _fraction(a: str, b: str) -> str:
    return f"case when {a}={b} then 0 else levenshtein({a},{b})::double/greatest(length({a}),length({b})) end"


# the extensions here are one word or none, so they are equal or one text apart
PARTS = f"""
  pairs as materialized (
    select old_fid, old_func, new_fid, new_func,
           rank() over (order by case when d>0.5 then 1 else d end, case when d>0.5 then (p+1)/2 else p end, e, old_func desc, new_func desc) rank
    from (select o.fid old_fid, o.func old_func, n.fid new_fid, n.func new_func, case when o.extension=n.extension then 0 else 1 end e,
                 ({_fraction('o.namespace', 'n.namespace')} + {_fraction('o.basename', 'n.basename')})/2 d, {_fraction('o.parameters', 'n.parameters')} p
          from old_f o join new_f n on regexp_replace(o.path,'\\.[^.]*$','')=regexp_replace(n.path,'\\.[^.]*$','')))"""


@query("nearest_parts_in_file", f"with {fx.FUNCTIONS}, {PARTS}, {ordered_rounds('pairs')} select * from won")
def nearest_parts_in_file(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy one-to-one links by (name, parameters, suffix) distance inside a file stem."""
    old, new, _ = _functions(spark, folder)
    stem = lambda f: f.withColumn("stem", F.regexp_replace("path", r"\.[^.]*\z", ""))
    return project.nearest_parts_in_file(stem(old), stem(new))


NAMED_PATHS = """
  pm as (select o.path old_path, n.path new_path from (select distinct path from old_src) o join (select distinct path from new_src) n
         on n.path=concat('new/',o.path))"""

_UNIQUE = """
  ou as (select min(path) path, code, min(line) line from old_src group by {key} having count(*)=1),
  nu as (select min(path) path, code, min(line) line from new_src group by {key} having count(*)=1),
  m as materialized (select pm.old_path, o.line old_line, pm.new_path, n.line new_line
        from pm join ou o on o.path=old_path join nu n on n.path=new_path and n.code=o.code)"""

# in some queries only lines that occur once in a whole version serve as anchors, so others are left between them
BASE, RARE_BASE = (f"{fx.EDITED_LINES}, {NAMED_PATHS}, {_UNIQUE.format(key=key)}" for key in ("path, code", "code"))


def _base(spark: SparkSession, folder: str, rare: bool = False):
    """Edited lines, the path links, and the links of lines unique in their paths."""
    old, new = fx.edited_lines(spark, folder)
    old, new = keep(old), keep(new.drop("true_old_line"))
    path_map = settle(paths.link_paths_by_name(old.select("path"), new.select("path")))
    once = lambda src: src.join(src.groupBy("code").count().where("count = 1").select("code"), "code", "left_semi")
    links = keep(ln.equal_unique_lines(*(once(src) if rare else src for src in (old, new)), path_map))
    return old, new, path_map, links, ln.largest_line(old, new)


@query("line_equal_unique", f"with {BASE} select * from m")
def line_equal_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder)[3]


def anchors(s: str, o: str) -> str:
    fill = lambda c, d: (
        f"last_value({c} ignore nulls) over (partition by path order by line rows between unbounded preceding and current row)" if d else
        f"first_value({c} ignore nulls) over (partition by path order by line rows between current row and unbounded following)")
    return f"""
      a_{s} as (select x.path, x.line, x.code, m.{o}_path here_path, m.{o}_line here from {s}_src x left join m on m.{s}_path=x.path and m.{s}_line=x.line),
      g_{s} as (select path, line, code, here, {fill('here_path', True)} pp, {fill('here', True)} pl, {fill('here_path', False)} np, {fill('here', False)} nl from a_{s}),
      i_{s} as materialized (select path {s}_path, line {s}_line, code, coalesce(pp,np) {o}_path, coalesce(pl,0) {o}_line_prev, coalesce(nl,9223372036854775807) {o}_line_next
             from g_{s} where here is null and coalesce(pp,np)=coalesce(np,pp)),
      tight_{s} as (select * from i_{s} where {o}_line_prev<{o}_line_next-1),
      ranked_{s} as (select *, row_number() over (partition by {s}_path, code, {o}_line_prev order by {s}_line) rank_inc,
                            count(*) over (partition by {s}_path, code, {o}_line_prev) rank_count from i_{s} where {o}_line_prev<{o}_line_next),
      around_{s} as (select {s}_path path, {s}_line line, {o}_path lp, {o}_line ll, coalesce(lag({o}_line) over (partition by {o}_path order by {o}_line),0) lb,
                          coalesce(lead({o}_line) over (partition by {o}_path order by {o}_line),9223372036854775807) la from m),
      la_{s} as (select x.path, x.line, x.code, r.lp, r.ll, r.lb, r.la from {s}_src x left join around_{s} r on r.path=x.path and r.line=x.line),
      lg_{s} as (select path, line, code, ll here, {fill('lp', True)} pp, {fill('ll', True)} pl, {fill('la', True)} pa,
                       {fill('lp', False)} np, {fill('ll', False)} nl, {fill('lb', False)} nb from la_{s}),
      loose_{s} as (select path {s}_path, line {s}_line, code, pp {o}_path, pl {o}_line_prev, pa {o}_line_next from lg_{s} where here is null and pp is not null
                 union select path, line, code, np, nb, nl from lg_{s} where here is null and np is not null)"""


INSIDE = "old_line>old_line_prev and old_line<old_line_next and new_line>new_line_prev and new_line<new_line_next"
BOUNDS, RARE_BOUNDS = (f"{base}, {anchors('old', 'new')}, {anchors('new', 'old')}" for base in (BASE, RARE_BASE))


@query("line_bounds_tight", f"with {BOUNDS} select * from tight_old")
def line_bounds_tight(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return tight_bounds(old, "old", "new", links, top)


@query("line_bounds_loose", f"with {BOUNDS} select * from loose_new")
def line_bounds_loose(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return loose_bounds(new, "new", "old", links, top)


@query("line_bounds_ranked", f"with {BOUNDS} select *, rank_count-rank_inc+1 rank_dec from ranked_old")
def line_bounds_ranked(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return ranked_bounds(old, "old", "new", links, top)


@query("line_equal_between", f"""
  with {RARE_BOUNDS},
  oo as (select path old_path, code, min(line) old_line, coalesce(min(pl),0) new_line_prev, coalesce(min(nl),9223372036854775807) new_line_next
         from g_old where here is null group by 1,2 having count(*)=1),
  nn as (select path new_path, code, min(line) new_line, coalesce(min(pl),0) old_line_prev, coalesce(min(nl),9223372036854775807) old_line_next
         from g_new where here is null group by 1,2 having count(*)=1),
  p as (select old_path, old_line, new_path, new_line from pm join oo using (old_path) join nn using (new_path, code) where {INSIDE})
  select * exclude (a,b) from (select *, count(*) over (partition by old_path,old_line) a, count(*) over (partition by new_path,new_line) b from p) where a=1 and b=1""")
def line_equal_between(spark: SparkSession, folder: str) -> DataFrame:
    old, new, path_map, links, top = _base(spark, folder, rare=True)
    return ln.equal_lines_between(old, new, path_map, links, top)


@query("line_equal_repeated", f"""
  with {BOUNDS},
  p as (select old_path, old_line, new_path, new_line, least(old_line-old_line_prev,old_line_next-old_line) od, least(new_line-new_line_prev,new_line_next-new_line) nd
        from ranked_old join ranked_new using (old_path,new_path,code,rank_count,rank_inc) where {INSIDE}),
  q as (select * from (select *, min(od) over (partition by old_path,old_line) mo, min(nd) over (partition by new_path,new_line) mn from p) where od=mo and nd=mn)
  select old_path, old_line, new_path, new_line from (select *, count(*) over (partition by old_path,old_line) a, count(*) over (partition by new_path,new_line) b from q) where a=1 and b=1""")
def line_equal_repeated(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return ln.link_equal_repeated(old, new, links, top)


FUZZY = f"""
  p as (select old_path, old_line, new_path, new_line, {edit('o.code', 'n.code')} s,
               greatest(least(old_line-old_line_prev,old_line_next-old_line),least(new_line-new_line_prev,new_line_next-new_line)) d
        from tight_old o join tight_new n using (old_path,new_path) where {INSIDE}),
  q as (select * from (select *, max(s) over (partition by old_path,old_line) mo, max(s) over (partition by new_path,new_line) mn from p) where s=mo and s=mn),
  r as (select * from (select *, min(d) over (partition by old_path,old_line) eo, min(d) over (partition by new_path,new_line) en from q) where d=eo and d=en)"""


@query("line_fuzzy", f"""
  with {BOUNDS}, {FUZZY}
  select old_path, old_line, new_path, new_line from (select *, count(*) over (partition by old_path,old_line) a, count(*) over (partition by new_path,new_line) b from r) where a=1 and b=1""")
def line_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return ln.link_fuzzy(old, new, old.select("path", "line"), new.select("path", "line"), links, top)


def words_sql(s: str) -> str:
    return f"""
      c_{s} as (select * exclude code, regexp_replace(code,'//[^\\n]*','') code from tight_{s}),
      u_{s} as (select *, unnest(string_split(regexp_replace(trim(regexp_replace(code,'\\s+',' ','g')),'^\\s+|\\s+$','','g'),' ')) word,
                      generate_subscripts(string_split(regexp_replace(trim(regexp_replace(code,'\\s+',' ','g')),'^\\s+|\\s+$','','g'),' '),1) p from c_{s}),
      k_{s} as (select * exclude p, row_number() over (partition by {s}_path,{s}_line,word order by p) k from u_{s})"""


@query("line_words", f"""
  with {BOUNDS}, {words_sql('old')}, {words_sql('new')}
  select old_path, old_line, new_path, new_line, o.code old_code, n.code new_code,
         round(sum(length(word)::double/greatest(length(o.code),length(n.code))),10) len
  from k_old o join k_new n using (old_path,new_path,word,k) where {INSIDE} group by all""")
def line_words(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return ln.word_pairs(old, new, links, top)


def word_links_sql(rounds: int) -> str:
    """Rounds on the word weight, then on weight and similarity of what is left; the last ones must find nothing."""
    ends, columns = ("old_path,old_line", "new_path,new_line"), "old_path, old_line, new_path, new_line"
    free = " and ".join(f"({end}) not in (select ({end}) from first_links)" for end in ends)
    return f"""
      with {BOUNDS}, {words_sql('old')}, {words_sql('new')},
      weighed as materialized (select old_path, old_line, new_path, new_line, o.code old_code, n.code new_code,
             round(sum(length(word)::double/greatest(length(o.code),length(n.code))),10) len
        from k_old o join k_new n using (old_path,new_path,word,k) where {INSIDE} group by all),
      first_links as materialized (select * from (with {unique_rounds("weighed", *ends, ["len"], rounds, columns)} select * from won)),
      rest as materialized (select *, {edit('old_code', 'new_code')} similarity from weighed where {free}),
      second_links as (select * from (with {unique_rounds("rest", *ends, ["len", "similarity"], rounds, columns)} select * from won))
      select * from first_links union all select * from second_links"""


@query("line_link_words", word_links_sql(10))
def line_link_words(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return ln.link_by_words(old, new, links, top)


@query("line_link_all")
def line_link_all(spark: SparkSession, folder: str) -> DataFrame:
    """Line links of the documents and their edited version, every loop until dry."""
    old, new = fx.edited_lines(spark, folder)
    place = ["path", "line"]
    return ln.link_lines(old, new.drop("true_old_line"), old.select(*place), new.select(*place))


def _function_lines(spark: SparkSession, folder: str):
    """Ten lines each form a function; functions of the same number are linked."""
    old, new, _, links, top = _base(spark, folder)

    def owned(src: DataFrame) -> DataFrame:
        doc = F.element_at(F.split("path", "/"), -1).cast("bigint")
        return src.select((doc * 10000 + F.floor(F.col("line") / 10)).alias("fid"), "path", "line", "code")

    old, new = owned(old), owned(new)
    ids = lambda f: f.select("fid").distinct()
    func_map = keep(ids(old).join(ids(new), "fid").select(F.col("fid").alias("old_fid"), F.col("fid").alias("new_fid")))
    return old, new, func_map, links, top


def owner(s: str) -> str:
    return f"f_{s} as materialized (select regexp_replace(path,'^.*/','')::bigint*10000+line//10 fid, path, line, code from {s}_src)"


OWNED = f"{owner('old')}, {owner('new')}, fm as (select distinct o.fid old_fid, o.fid new_fid from f_old o join f_new n on n.fid=o.fid)"


def alone(pairs: str) -> str:
    return f"""select old_path, old_line, new_path, new_line from (select *, count(*) over (partition by old_path,old_line) ca,
      count(*) over (partition by new_path,new_line) cb from ({pairs})) where ca=1 and cb=1"""


@query("line_same_code_tight", f"with {BOUNDS} " + alone(
    f"select distinct old_path,old_line,new_path,new_line from tight_old join tight_new using (old_path,new_path,code) where {INSIDE}"))
def line_same_code_tight(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return function_lines.same_code_inside(tight_bounds(old, "old", "new", links, top), tight_bounds(new, "new", "old", links, top), top)


@query("line_same_code_loose", f"with {BOUNDS} " + alone(
    f"select distinct old_path,old_line,new_path,new_line from loose_old join loose_new using (old_path,new_path,code) where {INSIDE}"))
def line_same_code_loose(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder)
    return function_lines.same_code_inside(loose_bounds(old, "old", "new", links, top), loose_bounds(new, "new", "old", links, top), top)


@query("line_same_code_anywhere", f"with {RARE_BOUNDS} " + alone(
    "select distinct old_path,old_line,new_path,new_line from loose_old join loose_new using (old_path,new_path,code)"))
def line_same_code_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    old, new, _, links, top = _base(spark, folder, rare=True)
    return function_lines.same_code_anywhere(loose_bounds(old, "old", "new", links, top), loose_bounds(new, "new", "old", links, top))


@query("line_same_code_same_owners", f"""with {BOUNDS}, {OWNED},
  bo as (select distinct l.*, f.fid old_fid, count(distinct f.fid) over (partition by old_path, old_line) c from loose_old l join f_old f on f.path=old_path and f.line=old_line),
  bn as (select distinct l.*, f.fid new_fid, count(distinct f.fid) over (partition by new_path, new_line) c from loose_new l join f_new f on f.path=new_path and f.line=new_line),
  g as (select distinct old_fid, new_fid, old_path, old_line, new_path, new_line, bo.c from bo join fm using (old_fid) join bn using (new_fid, old_path, new_path, code) where bo.c=bn.c)
  """ + alone("select old_path,old_line,new_path,new_line from g group by all having count(*)=max(c)"))
def line_same_code_same_owners(spark: SparkSession, folder: str) -> DataFrame:
    old, new, func_map, links, top = _function_lines(spark, folder)
    side = lambda f, s, o: function_lines._bounds_by_function(
        loose_bounds(function_lines.digested(f).select("path", "line", "code").distinct(), s, o, links, top), f, s)
    return function_lines.same_code_same_owners(side(old, "old", "new"), side(new, "new", "old"), func_map)


FSRC = "fs as materialized (select o.fid old_fid, old_path, old_line, n.fid new_fid, new_path, new_line from m join f_old o on o.path=old_path and o.line=old_line join fm on fm.old_fid=o.fid join f_new n on n.path=new_path and n.line=new_line and n.fid=fm.new_fid)"
FBASE = f"{BOUNDS}, {OWNED}, {FSRC}"
FCOLS = "old_fid, old_path, old_line, new_fid, new_path, new_line"


@query("function_line_links", f"with {FBASE} select * from fs")
def function_line_links(spark: SparkSession, folder: str) -> DataFrame:
    old, new, func_map, links, _ = _function_lines(spark, folder)
    return function_lines.lines_by_function(links, old, new, func_map)


@query("line_fallback_1", f"""with {FBASE},
  bo as (select distinct l.old_path, l.old_line, l.code, l.new_path, f.fid old_fid from loose_old l join f_old f on f.path=old_path and f.line=old_line),
  bn as (select distinct l.new_path, l.new_line, l.code, l.old_path, f.fid new_fid from loose_new l join f_new f on f.path=new_path and f.line=new_line),
  p as (select distinct {FCOLS}, {edit('bo.code', 'bn.code')} s from bo join fm using (old_fid) join bn using (new_fid, old_path, new_path)),
  q as (select *, max(s) over (partition by old_path, old_line) a, max(s) over (partition by new_path, new_line) b from p where s>=0.9)
  select {FCOLS} from q where s=a or s=b""")
def line_fallback_1(spark: SparkSession, folder: str) -> DataFrame:
    old, new, func_map, links, top = _function_lines(spark, folder)
    side = lambda f, s, o: function_lines.open_by_function(f, s, o, links, top)
    return function_lines.near_lines_between(side(old, "old", "new"), side(new, "new", "old"), func_map, old, new)


def fallback_sql(by_path: bool, one_sided: bool) -> str:
    met = "join (select distinct old_path, new_path, {o}_fid from fs) x on x.{s}_path={s}.path and x.{o}_fid=fm.{o}_fid" if by_path else ""
    on_path = " and {o}.path=x.{o}_path" if by_path else ""
    key = lambda s: f"{s}_fid, {s}_path, {s}_line"
    open_rows = lambda s: f"(select * from f_{s} where (fid,path,line) not in (select ({key(s)}) from fs))"

    def part(s: str, o: str, both: bool) -> str:
        rows = f"""select {s}.fid {s}_fid, {s}.path {s}_path, {s}.line {s}_line, {o}.fid {o}_fid, {o}.path {o}_path, {o}.line {o}_line, {edit('old.code', 'new.code')} sim
          from {open_rows(s)} {s} join fm on fm.{s}_fid={s}.fid {met.format(s=s, o=o)}
          join {open_rows(o) if both else f'f_{o}'} {o} on {o}.fid=fm.{o}_fid{on_path.format(o=o)}"""
        test = "sim=a or sim=b" if both else "sim=a"
        return f"select distinct {FCOLS} from (select *, max(sim) over (partition by {key(s)}) a, max(sim) over (partition by {key(o)}) b from ({rows})) where {test}"

    if not one_sided:
        return f"with {FBASE} {part('old', 'new', True)}"
    return f"with {FBASE} {part('old', 'new', False)} union all {part('new', 'old', False)}"


def _fallback_query(number: int, by_path: bool, one_sided: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        old, new, func_map, links, _ = _function_lines(spark, folder)
        done = keep(function_lines.lines_by_function(links, old, new, func_map))
        named = lambda f, s: function_lines._named(f, s)
        return function_lines._fallback(named(old, "old"), named(new, "new"), func_map, done, by_path, one_sided)

    query(f"line_fallback_{number}", fallback_sql(by_path, one_sided))(run)


_fallback_query(2, True, False)
_fallback_query(3, True, True)
_fallback_query(4, False, False)
_fallback_query(5, False, True)


@query("line_link_with_functions")
def line_link_with_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Line links per function pair: the link steps until dry, then all fallbacks."""
    old, new, func_map, links, _ = _function_lines(spark, folder)
    return function_lines.link_lines_with_functions(old, new, func_map, links)


SCORES = f"""
  scores as materialized (select o.fid old_fid, n.fid new_fid, sum((length(o.code)+length(n.code)-levenshtein(o.code,n.code))//2)::bigint score
    from m join f_old o on o.path=old_path and o.line=old_line join f_new n on n.path=new_path and n.line=new_line group by 1,2),
  present as (select old_fid, new_fid from fm join (select fid, arg_min(code,line) c from f_old group by 1) a on a.fid=old_fid
    join (select fid, arg_min(code,line) c from f_new group by 1) b on b.fid=new_fid and b.c=a.c)"""


def _scores(spark: SparkSession, folder: str):
    old, new, func_map, links, _ = _function_lines(spark, folder)
    place = lambda f: f.select("fid", "path", "line")
    code = lambda f: f.select("path", "line", "code").distinct()
    scores = keep(overlap.overlap_scores(links, place(old), place(new), code(old), code(new)))
    first = lambda side, s: side.groupBy(F.col("fid").alias(f"{s}_fid")).agg(F.min_by("code", "line").alias("first"))
    return scores, func_map.join(first(old, "old"), "old_fid").join(first(new, "new"), ["new_fid", "first"]).drop("first")


@query("overlap_scores", f"with {BASE}, {OWNED}, {SCORES} select * from scores")
def overlap_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)[0]


@query("overlap_score_links", f"""
  with {BASE}, {OWNED}, {SCORES},
  free as (select * from scores where old_fid not in (select old_fid from present) and new_fid not in (select new_fid from present)),
  {unique_rounds("free", "old_fid", "new_fid", ["score"], 10, "old_fid, new_fid")} select * from won""")
def overlap_score_links(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.link_by_overlap(*_scores(spark, folder))


def secondary_sql(s: str, o: str) -> str:
    return f"""
      s1_{s} as (select *, max(score) over (partition by {s}_fid) mx, sum(case when has then score else 0 end) over (partition by {s}_fid) ps from sc),
      s2_{s} as (select *, max(score) over (partition by {o}_fid) my from s1_{s} where score>ps and score=mx and not has),
      s3_{s} as (select old_fid, new_fid, score, count(*) over (partition by old_fid) a, count(*) over (partition by new_fid) b from s2_{s} where score=my)"""


@query("secondary_links", f"""
  with {BASE}, {OWNED}, {SCORES},
  sc as (select s.*, p.old_fid is not null has from scores s left join present p on p.old_fid=s.old_fid and p.new_fid=s.new_fid),
  {secondary_sql('old', 'new')}, {secondary_sql('new', 'old')},
  u as (select old_fid, new_fid, score from s3_old where a=1 and b=1 union select old_fid, new_fid, score from s3_new where a=1 and b=1),
  {unique_rounds("u", "old_fid", "new_fid", ["score"], 1, "old_fid, new_fid")} select * from won""")
def secondary_links(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.secondary_links(*_scores(spark, folder))


@query("closest_lines", f"""
  with {fx.EDITED_LINES},
  o as (select distinct regexp_replace(path,'^.*/','')::bigint doc, code old_code from old_src),
  n as (select distinct regexp_replace(path,'^.*/','')::bigint doc, code new_code from new_src),
  p as (select doc, old_code, new_code, {edit('old_code', 'new_code')} similarity from o join n using (doc)),
  q as (select *, similarity=max(similarity) over (partition by doc, old_code) best_left, similarity=max(similarity) over (partition by doc, new_code) best_right from p)
  select * from q where best_left or best_right""")
def closest_lines(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.edited_lines(spark, folder)
    doc = F.element_at(F.split("path", "/"), -1).cast("bigint").alias("doc")
    # numbering the new lines moves their texts, so it is done once
    new = keep(new.select(doc, F.col("code").alias("new_code")))
    return closest(old.select(doc, F.col("code").alias("old_code")), new, ["doc"], "old_code", "new_code")


@query("similar_lines", f"""
  with {fx.EDITED_LINES},
  o as (select distinct regexp_replace(path,'^.*/','')::bigint doc, code old_code from old_src),
  n as (select distinct regexp_replace(path,'^.*/','')::bigint doc, code new_code from new_src),
  p as (select doc, old_code, new_code, {edit('old_code', 'new_code')} similarity from o join n using (doc))
  select * from p where similarity>=0.9""")
def similar_lines(spark: SparkSession, folder: str) -> DataFrame:
    old, new = fx.edited_lines(spark, folder)
    doc = F.element_at(F.split("path", "/"), -1).cast("bigint").alias("doc")
    return similar_pairs(old.select(doc, F.col("code").alias("old_code")), new.select(doc, F.col("code").alias("new_code")), ["doc"], "old_code", "new_code", 0.9)
