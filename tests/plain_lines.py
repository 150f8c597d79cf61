"""The line linkage in plain Python over lists, as its definition reads: slow, and for small tables only.

Versions are ``{path: [(line, code), ...]}`` in line order, links are
``(old_path, old_line, new_path, new_line)``.
"""

import re
from collections import Counter, defaultdict

TOP = 2**63 - 1
SKIPPED = re.compile(r"^\s*#|^\s*[\{\}]\Z")


def stripped(code):
    return re.sub(r"//[^\n]*", "", code)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b, known={}):
    if a == b:
        return 1.0
    if (a, b) not in known:
        known[a, b] = 1.0 - edits(a, b) / max(len(a), len(b))
    return known[a, b]


def alone(pairs):
    """Pairs whose old and new line are in no other pair."""
    pairs = set(pairs)
    left, right = Counter(p[:2] for p in pairs), Counter(p[2:] for p in pairs)
    return {p for p in pairs if left[p[:2]] == 1 and right[p[2:]] == 1}


def single(rows, clean):
    """(path, code) -> line, where only one of the rows (path, line, code) has it."""
    count = Counter((path, clean(code)) for path, _, code in rows)
    return {(path, clean(code)): line for path, line, code in rows if count[path, clean(code)] == 1}


def around(src, links, side):
    """Per unlinked line the linked other-side lines before and after it in its path."""
    to = {l[:2]: l[2:] for l in links} if side == 0 else {l[2:]: l[:2] for l in links}
    out = {}
    for path, lines in src.items():
        before = None
        for line, _ in lines:
            if (path, line) in to:
                before = to[path, line]
            else:
                out[path, line] = [before, None]
        after = None
        for line, _ in reversed(lines):
            if (path, line) in to:
                after = to[path, line]
            elif (path, line) in out:
                out[path, line][1] = after
    return out


def inside(old_line, new_line, of_old, of_new):
    return of_new[0] < old_line < of_new[1] and of_old[0] < new_line < of_old[1]


def unique_steps(old, new, old_rows, new_rows, path_map):
    """Equal lines unique in linked paths, then between the links so found, until dry, with and without comments."""
    a, b = single(old_rows, str), single(new_rows, str)
    found = alone((o, a[o, code], n, line) for o, n in path_map for (p, code), line in b.items() if p == n and (o, code) in a)
    cleans = [str, stripped]
    while cleans:
        sides = []
        for rows, side in ((old_rows, 0), (new_rows, 1)):
            done = {l[2 * side : 2 * side + 2] for l in found}
            src = defaultdict(list)
            for path, line, code in rows:
                src[path].append((line, code))
            near = around(src, found, side)
            ends = {k: (p[1] if p else 0, n[1] if n else TOP) for k, (p, n) in near.items()}
            sides.append((single([r for r in rows if r[:2] not in done], cleans[0]), ends))
        (a, of_old), (b, of_new) = sides
        more = alone(
            (o, a[o, code], n, line) for o, n in path_map for (p, code), line in b.items()
            if p == n and (o, code) in a and inside(a[o, code], line, of_old[o, a[o, code]], of_new[n, line])
        )
        if more:
            found |= more
        else:
            cleans = cleans[1:]
    return found


def bounds(src, links, side, room):
    """(path, line, code) -> other path, before, after."""
    out = {}
    for (path, line), (p, n) in around(src, links, side).items():
        first, last = p or n, n or p
        if first and first[0] == last[0]:
            low, high = p[1] if p else 0, n[1] if n else TOP
            if low < high - room:
                out[path, line] = (first[0], low, high)
    return out


def nearest(pairs, of_old, of_new):
    kept = []
    for o, n in pairs:
        (to, a, b), (back, c, d) = of_old[o], of_new[n]
        if to == n[0] and back == o[0] and inside(o[1], n[1], (a, b), (c, d)):
            kept.append((o, n, min(o[1] - c, d - o[1]), min(n[1] - a, b - n[1])))
    least_o, least_n = {}, {}
    for o, n, x, y in kept:
        least_o[o], least_n[n] = min(least_o.get(o, TOP), x), min(least_n.get(n, TOP), y)
    return alone((*o, *n) for o, n, x, y in kept if x == least_o[o] and y == least_n[n])


def repeated_step(old, new, links):
    of_old, of_new = bounds(old, links, 0, 0), bounds(new, links, 1, 0)
    sides = []
    for src, of in ((old, of_old), (new, of_new)):
        codes = {(p, line): code for p, lines in src.items() for line, code in lines}
        groups = defaultdict(list)
        for (p, line), (_, low, _) in of.items():
            groups[p, codes[p, line], low].append(line)
        sides.append((codes, groups))
    for clean in (str, stripped):
        for step in (1, 2):
            keyed = []
            for codes, groups in sides:
                rows = defaultdict(list)
                for (p, code, _), lines in groups.items():
                    lines = sorted(lines)
                    for k, line in enumerate(lines, 1):
                        if step == 1:
                            rows[clean(code), k, len(lines)].append((p, line))
                        elif k == 1 or k == len(lines):
                            rows[clean(code), "first" if k == 1 else "last"].append((p, line))
                keyed.append(rows)
            won = nearest([(o, n) for key, own in keyed[0].items() for o in own for n in keyed[1].get(key, ())], of_old, of_new)
            if won:
                return won
    return set()


def fuzzy_step(old, new, listed_old, listed_new, links):
    of_old, of_new = bounds(old, links, 0, 1), bounds(new, links, 1, 1)
    codes = [{(p, line): code for p, lines in src.items() for line, code in lines} for src in (old, new)]
    by_path = defaultdict(list)
    for n in of_new:
        if n in listed_new:
            by_path[n[0], of_new[n][0]].append(n)
    pairs = []
    for o, (to, a, b) in of_old.items():
        if o in listed_old:
            for n in by_path.get((to, o[0]), ()):
                if inside(o[1], n[1], (a, b), of_new[n][1:]):
                    c, d = of_new[n][1:]
                    pairs.append((o, n, similarity(codes[0][o], codes[1][n]), max(min(o[1] - c, d - o[1]), min(n[1] - a, b - n[1]))))
    for key, sign in ((2, -1), (3, 1)):
        least_o, least_n = {}, {}
        for p in pairs:
            least_o[p[0]] = min(least_o.get(p[0], TOP), sign * p[key])
            least_n[p[1]] = min(least_n.get(p[1], TOP), sign * p[key])
        pairs = [p for p in pairs if sign * p[key] == least_o[p[0]] == least_n[p[1]]]
    return alone((*p[0], *p[1]) for p in pairs)


def by_name(old, new):
    out = []
    for o in old:
        same = [n for n in new if n.rsplit("/", 1)[-1] == o.rsplit("/", 1)[-1]]
        if same:
            best = max(similarity(o, n) for n in same)
            out.append((o, min(n for n in same if similarity(o, n) == best)))
    return out


def by_content(old_rows, new_rows):
    sides = []
    for rows in (old_rows, new_rows):
        k, held = Counter(), defaultdict(list)
        for path, _, code in sorted(rows):
            if not SKIPPED.search(code):
                k[path, code] += 1
                held[code, k[path, code]].append(path)
        sides.append(held)
    weight = Counter()
    for key, paths in sides[0].items():
        for o in paths:
            for n in sides[1].get(key, ()):
                weight[o, n] += len(key[0])
    best_o, best_n = Counter(), Counter()
    for (o, n), w in weight.items():
        best_o[o], best_n[n] = max(best_o[o], w), max(best_n[n], w)
    top = [p for p, w in weight.items() if w == best_o[p[0]] == best_n[p[1]]]
    left, right = Counter(o for o, _ in top), Counter(n for _, n in top)
    return [(o, n) for o, n in top if left[o] == 1 and right[n] == 1]


def link_lines(old, new, listed_old, listed_new, log=None):
    links, path_map, used = set(), by_name(old, new), False
    rows = [[(p, line, code) for p, lines in src.items() for line, code in lines] for src in (old, new)]

    def still_open():
        done_o, done_n = {l[:2] for l in links}, {l[2:] for l in links}
        return [r for r in rows[0] if r[:2] not in done_o], [r for r in rows[1] if r[:2] not in done_n]

    def equal_steps(open_old, open_new):
        first = unique_steps(old, new, open_old, open_new, path_map)
        links.update(first)
        second = repeated_step(old, new, links)
        links.update(second)
        if log is not None:
            log.append(("equal", len(first), len(second)))
        return first or second

    while True:
        open_old, open_new = still_open()
        if equal_steps(open_old, open_new):
            used = True
            continue
        if not used:
            break
        path_map, used = by_content(open_old, open_new), False
        if log is not None:
            log.append(("paths", len(path_map)))
    while True:
        open_old, open_new = still_open()
        if equal_steps([r for r in open_old if r[:2] in listed_old], [r for r in open_new if r[:2] in listed_new]):
            continue
        won = fuzzy_step(old, new, listed_old, listed_new, links)
        links |= won
        if log is not None:
            log.append(("fuzzy", len(won)))
        if not won:
            return links
