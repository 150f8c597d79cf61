"""A version read from written logs, listing, profile and sources, and its links written twice."""

import gzip

from versionlink.plans.pipeline import link_versions, profiled_functions, read_version, write_links
from versionlink.sources import files

CODE = ["int f() {", "  call(a); // first", "  return one;", "}", "int g() {", "  /* two", "  lines */ return two;", "}"]


def write_version(folder, changed=False):
    src = folder / "src"
    (src / "sub").mkdir(parents=True)
    code = [c.replace("one", "ones") if changed else c for c in CODE]
    (src / "sub" / "a [1]+b.c").write_text("\n".join(code) + "\n")
    (src / "unused.c").write_text("never opened\n")
    path = src / "sub" / "a [1]+b.c"
    log = ["noise"]
    listing = ["  ff: \tnop", ]
    for k, (name, line) in enumerate((("f", 1), ("g", 5))):
        fid = 4096 * (k + 1)
        log.append(f"Tool-LineInfo#{name}()#ns#{name}#()##{path}#{line}#1#{k}#{k}#2")
        log.append(f"Tool-Counts: func {name}(),{name}_alias, 7 {fid} 1 0")
        for bid in (0, 1):
            log.append(f"Tool-Counts: node {fid}#{bid} 3 {16 * bid} {16 * bid + 16} {100 * k + bid} 2")
            listing.append(f"; {path}:{line + 1 + bid}")
            listing += [f"  {fid + 16 * bid + 4 * i:x}: \t{('mov', 'jmp')[i]}\t%r{bid}{i}" for i in (0, 1)]
        log.append(f"Tool-Counts: edge {fid}#0 {fid}#1 5")
    (folder / "log.txt").write_text("\n".join(log) + "\n")
    (folder / "profile.txt").write_text("names:\n  - name:   'f()'\n  - name:   'unknown'\n")
    with gzip.open(folder / "listing.gz", "wt") as out:
        out.write("\n".join(listing) + "\n")
    return path


def test_read_link_and_write(spark, tmp_path):
    versions = []
    for name in ("old", "new"):
        folder = tmp_path / name
        path = write_version(folder, name == "new")
        v = read_version(spark, str(folder / "log.txt"), [str(folder / "src")], str(folder / "listing.gz"),
                         str(folder / "profile.txt") if name == "old" else None)
        versions.append(v)
        fids = {4096} if name == "old" else {4096, 8192}
        assert {r.fid for r in v.items.collect()} == fids and v.items.count() == 4 * len(fids)
        assert {r.path for r in v.items.collect()} == {str(path)} == {r.path for r in v.lines.collect()}
        assert {(r.line, r.code.strip()) for r in v.lines.collect()} >= {(1, "int f() {"), (7, "return two;")}
        assert v.functions.count() == 4 and v.nodes.count() == 4 and v.edges.count() == 2
    old, new = versions
    profiled = profiled_functions(spark, old.functions, str(tmp_path / "old" / "profile.txt"))
    assert [tuple(r) for r in profiled.collect()] == [(4096, "f()")]
    links = link_versions(old, new, profiled)
    out = str(tmp_path / "out")
    for _ in range(2):  # a rerun leaves one copy
        write_links(links, out)
        assert [tuple(r) for r in spark.read.csv(f"{out}/functions").collect()] == [("f()", "f()")]
        assert sorted(tuple(r) for r in spark.read.csv(f"{out}/blocks").collect()) == [("f()", "0", "0"), ("f()", "1", "1")]
        assert spark.read.text(f"{out}/cross").count() == 0


def test_only_wanted_files_are_opened(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.c").write_text(f"code {k}\n")
    listed = files.read_paths(spark, [str(tmp_path)])
    wanted = listed.where("path like '%f2.c' or path like '%f5.c'").unionByName(spark.createDataFrame([("/elsewhere.c",)], "path string"))
    rows = files.read_sources(spark, [str(tmp_path)], wanted)
    assert sorted(f.rsplit("/", 1)[-1] for f in rows.inputFiles()) == ["f2.c", "f5.c"]
    assert sorted(r.code for r in rows.collect()) == ["code 2", "code 5"]
    assert files.read_sources(spark, [str(tmp_path)], wanted.limit(0)).count() == 0
    assert files.read_sources(spark, [str(tmp_path)]).count() == 6
