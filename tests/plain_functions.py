"""The function cascade in plain Python over lists, as its definition reads: for small tables only.

Rows are dicts with ``fid, func, namespace, basename, parameters, extension, chunk, path``.
"""

from plain_lines import by_name, similarity
from versionlink.plans import functions as fn


def value(row, column):
    return row["path"].rsplit("/", 1)[-1] if column == "file" else row[column]


def score(level, o, n):
    out = []
    for c in level.score:
        if c == "one":
            out.append(1)
        elif c == "len":
            out.append(-abs(len(o["func"]) - len(n["func"])))
        elif c == fn.NAME:
            out.append(similarity(o["namespace"], n["namespace"]) + similarity(o["basename"], n["basename"]))
        else:
            out.append(similarity(o[c], n[c]))
    return tuple(out)


def rounds(pairs):
    """pairs: (score, old_func, new_func, old_fid, new_fid, ...), one to one by best score, first by names."""
    won = []
    while pairs:
        best_o, best_n = {}, {}
        for p in pairs:
            best_o[p[3]] = max(best_o.get(p[3], p[0]), p[0])
            best_n[p[4]] = max(best_n.get(p[4], p[0]), p[0])
        first_o, first_n = {}, {}
        for p in pairs:
            if p[0] == best_o[p[3]] == best_n[p[4]]:
                first_o[p[3]] = min(first_o.get(p[3], p), p, key=lambda x: x[1:])
        for p in first_o.values():
            first_n[p[4]] = min(first_n.get(p[4], p), p, key=lambda x: x[1:])
        won += first_n.values()
        done_o, done_n = {p[3] for p in first_n.values()}, {p[4] for p in first_n.values()}
        pairs = [p for p in pairs if p[3] not in done_o and p[4] not in done_n]
    return won


def run(levels, old, new, profiled, found):
    for level in levels:
        key = lambda r: tuple(value(r, c) for c in level.block)
        met = {}
        for n in new:
            met.setdefault(key(n), []).append(n)
        cold = lambda r: "cold" in r["extension"]
        pairs = [
            (score(level, o, n), o["func"], n["func"], o["fid"], n["fid"])
            for o in old if not level.profiled or o["func"] in profiled
            for n in met.get(key(o), ()) if not level.same_cold or cold(o) == cold(n)
        ]
        won = rounds(pairs)
        found += [(*p, level.name) for p in won]
        old_keys = {key(o) for o in old}
        done_o, done_n = {p[3] for p in won}, {p[4] for p in won}
        old, new = ([o for o in old if key(o) not in met and o["fid"] not in done_o],
                    [n for n in new if key(n) not in old_keys and n["fid"] not in done_n])
    return old, new


def once(old, new, profiled):
    """Links (old_fid, old_func, new_fid, new_func, level) of one pass; ``profiled`` has (fid, func)."""
    names = {func for _, func in profiled}
    found, rivals = [], []
    old, new = run(fn.LEVELS, old, new, names, found)
    for route in fn.ROUTES:
        run(route, old, new, names, rivals)
    by_func = [{r["func"]: r for r in rows} for rows in (old, new)]
    found += rounds([(score(fn.ALL, by_func[0][p[1]], by_func[1][p[2]]), *p[1:]) for p in rivals])
    return {(p[3], func, p[4], p[2], p[5]) for p in found for fid, func in profiled if fid == p[3]}


def all_links(old, new, profiled):
    paths = dict(by_name({r["path"]: 0 for r in old}, {r["path"]: 0 for r in new}))
    old = [r | {"path": paths.get(r["path"], r["path"])} for r in old]
    found = once(old, new, profiled)
    won = found
    while True:
        done_o, done_n = {l[0] for l in won}, {l[2] for l in won}
        profiled = [p for p in profiled if p[0] not in done_o]
        old = [r for r in old if r["fid"] in {fid for fid, _ in profiled}]
        new = [r for r in new if r["fid"] not in done_n]
        won = once(old, new, profiled) if old and new else set()
        if not won:
            break
        found = found | won
    rest = rounds([(score(fn.ALL, o, n), o["func"], n["func"], o["fid"], n["fid"]) for o in old for n in new])
    return found | {(p[3], p[1], p[4], p[2], fn.ALL.name) for p in rest}
