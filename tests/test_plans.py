from pyspark.sql import functions as F

from versionlink.plans import blocks, functions as fn, items, lines, project

INFO = "fid long, func string, namespace string, basename string, parameters string, extension string, chunk string, path string, line long"


def row(fid, func, ns, base, params, ext="", path="a/x.cpp"):
    return (fid, func, ns, base, params, ext, "1", path, fid)


def test_cascade_levels(spark):
    old = spark.createDataFrame([
        row(1, "same", "n", "same", "()"), row(2, "f(int)", "n", "f", "(int)"), row(3, "g.cold", "n", "g", "()", "cold"),
        row(4, "h", "n", "h", "()"), row(5, "unprofiled", "n", "u", "(long)"),
    ], INFO)
    new = spark.createDataFrame([
        row(11, "same", "n", "same", "()"), row(12, "f(long)", "n", "f", "(long)"), row(13, "g", "n", "g", "()"),
        row(14, "hh", "n", "hh", "()", path="b/x.cpp"), row(15, "u2", "n", "u", "(int)"),
    ], INFO)
    profiled = old.where("fid <> 5").select("fid", "func")
    once = {(r["old_fid"], r["new_fid"]): r["level"] for r in fn.link_functions_once(old, new, profiled).collect()}
    assert once[(1, 11)] == "func"
    assert once[(2, 12)] == "path_namespace_basename"
    assert (3, 13) not in once  # a cold part does not meet a whole function
    full = fn.link_functions(old, new, profiled)
    pairs = {(r["old_fid"], r["new_fid"]) for r in full.collect()}
    assert {o for o, _ in pairs} == {1, 2, 3, 4}
    assert len({n for _, n in pairs}) == 4


def test_lines_of_known_truth(spark):
    text = ["int main() {", "  int total = 0;", "  read(total);", "}", "int f() {", "  return 41;", "}", "// end", "done();"]
    kept = [i for i in range(len(text)) if i != 2]
    changed = {5: "  return 42;"}
    old = spark.createDataFrame([("a/m.c", i + 1, c) for i, c in enumerate(text)], "path string, line long, code string")
    new = spark.createDataFrame([("b/m.c", j + 1, changed.get(i, text[i])) for j, i in enumerate(kept)], "path string, line long, code string")
    place = ["path", "line"]
    got = lines.link_lines(old, new, old.select(*place), new.select(*place))
    pairs = sorted((r["old_line"], r["new_line"]) for r in got.collect())
    assert pairs == [(i + 1, j + 1) for j, i in enumerate(kept)]


def test_items_and_blocks(spark):
    ins = "fid long, bid long, path string, line long, address long, instruction string"
    old = spark.createDataFrame([(1, 0, "a", 1, 10, "jmp\t0x1 <f+0x10>"), (1, 0, "a", 1, 12, "mov\tx"), (1, 1, "a", 2, 14, "je\t<f+0x20>")], ins)
    new = spark.createDataFrame([(2, 0, "a", 1, 20, "jmp\t0x9 <f+0x18>"), (2, 0, "a", 1, 22, "mov\tx"), (2, 1, "a", 2, 24, "je\t<f+0x20>")], ins)
    links = spark.createDataFrame([(1, "a", 1, 2, "a", 1), (1, "a", 2, 2, "a", 2)],
                                  "old_fid long, old_path string, old_line long, new_fid long, new_path string, new_line long")
    candidates = items.item_candidates(old, new, links)
    jumps = sorted((r["old_index"], r["new_index"], r["jump_diff_score"]) for r in items.link_items(candidates).collect())
    assert jumps == [(10, 20, -8), (14, 24, 0)]  # only jumps pass the first tier
    every = {(r["old_index"], r["new_index"]) for r in items.link_items(candidates, jumps_only=False).collect()}
    assert every == {(10, 20), (12, 22), (14, 24)}
    node = "fid long, bid long, hash long"
    edge = "src_fid long, src_bid long, dst_fid long, dst_bid long"
    fmap = spark.createDataFrame([(1, 2)], "old_fid long, new_fid long")
    got = blocks.link_blocks(
        spark.createDataFrame([(1, 0, 7), (1, 1, 8)], node), spark.createDataFrame([(2, 0, 7), (2, 1, 9)], node),
        spark.createDataFrame([(1, 0, 1, 1)], edge), spark.createDataFrame([(2, 0, 2, 1)], edge),
        items.link_items(candidates), fmap)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 2, 0), (1, 1, 2, 1)]


def test_repeated_hash_blocks_take_each_other_out(spark):
    node = "fid long, bid long, hash long"
    fmap = spark.createDataFrame([(1, 11), (2, 11)], "old_fid long, new_fid long")
    old = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (2, 1, 6)], node)
    new = spark.createDataFrame([(11, 0, 5), (11, 1, 6)], node)
    got = blocks.link_blocks_by_hash(fmap, old, new)
    assert [tuple(r) for r in got.collect()] == [(2, 1, 11, 1)]


def test_projection_bars_explicit_blocks(spark):
    counts = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7)], "old_fid long, old_bid long, count long")
    link = "old_fid long, old_bid long, new_fid long, new_bid long"
    explicit = spark.createDataFrame([(1, 0, 2, 1), (1, 1, 2, -1)], link)
    weaker = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 2, 1), (1, 2, 2, 0), (1, 2, 2, 9)], link)
    size = spark.createDataFrame([(2, 3)], "new_fid long, blocks long")
    got = project.project_counts(counts, explicit, [weaker], size)
    assert sorted((r["old_bid"], r["new_bid"], r["count"]) for r in got.collect()) == [(0, 1, 5), (2, 0, 7)]


def test_unique_projection_offers_a_freed_target_again(spark):
    counts = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "old_fid long, old_bid long, count long")
    link = "old_fid long, old_bid long, new_fid long, new_bid long"
    rules = [spark.createDataFrame(rows, link) for rows in ([], [(1, 1, 2, 1)], [(1, 1, 2, 2), (1, 2, 2, 2)])]
    size = spark.createDataFrame([(2, 3)], "new_fid long, blocks long")
    got = project.project_counts(counts, rules[0], rules[1:], size, unique=True)
    assert sorted((r["old_bid"], r["new_bid"], r["count"]) for r in got.collect()) == [(1, 1, 5), (2, 2, 6)]
    assert project.project_counts(counts, rules[0], [rules[0]], size, unique=True).count() == 0
