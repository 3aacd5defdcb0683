"""Plain Python versions of what the operators compute, one text at a time."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality_counts(text: str) -> dict[str, int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def contamination(texts: list[str], items: list[tuple[object, str]]) -> list[tuple[int, int, list[str], bool]]:
    def words(text: str) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))

    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = words(text or "")
        for i in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(name))
    sizes = {len(x) for x in windows}
    out = []
    for text in texts:
        w, hit, names = words(text or ""), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    names |= found
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def components(docs: list[tuple[int, str]], k: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    ids = sorted(sets)

    def find(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def bound_walk(placed: list[tuple[int, int]], shards: int) -> None:
    """Checks (shard, slot): counts at most one apart, slots gapless from 0."""
    by: dict[int, list[int]] = {s: [] for s in range(shards)}
    for shard, slot in placed:
        by[shard].append(slot)
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def kneser_ney(rows: list[tuple[str, int]], d: float, d_pair: float):
    """Log ratios of class 1 to class 0 of a text's words, by interpolated Kneser-Ney models that are held in dictionaries."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    stem = lambda w: w.encode()[:4]
    pairs, words, contexts = ([Counter(), Counter()] for _ in range(3))
    for text, y in rows:
        ws = split(text)
        words[y].update(w for _, w in set(zip([None, *ws], ws, strict=False)))
        pairs[y].update(zip(ws, ws[1:], strict=False))
        contexts[y].update(ws[:-1])
    stems = [Counter(), Counter()]
    for y in (0, 1):
        for w, n in words[y].items():
            stems[y][stem(w)] += n
    total = [sum(x.values()) for x in words]
    cut = [d * n / min(total) for n in total]
    all_words, all_stems = words[0] + words[1], stems[0] + stems[1]
    left = lambda counts, c, n: sum(min(x, c) for x in counts.values()) / n

    def p_stem(s: bytes, y: int) -> float:
        shared = max(all_stems[s] - d, 0) / sum(total) + left(all_stems, d, sum(total)) / (len(all_stems) + 1)
        return max(stems[y][s] - cut[y], 0) / total[y] + left(stems[y], cut[y], total[y]) * shared

    def p_word(w: str, y: int) -> float:
        s = stem(w)
        own = {x: n for x, n in all_words.items() if stem(x) == s}
        n = all_stems[s]
        within = max(all_words[w] - d, 0) / n + left(own, d, n) / (len(own) + 1) if n else 1.0
        return max(words[y][w] - cut[y], 0) / total[y] + left(words[y], cut[y], total[y]) * p_stem(s, y) * within

    def p(before: str | None, w: str, y: int) -> float:
        least = min(contexts[0][before], contexts[1][before])
        if not least:
            return p_word(w, y)
        n, c = contexts[y][before], d_pair * contexts[y][before] / least
        own = {x: k for (v, x), k in pairs[y].items() if v == before}
        return max(pairs[y][before, w] - c, 0) / n + left(own, c, n) * p_word(w, y)

    def ratios(text: str) -> list[float]:
        ws = split(text)
        return [math.log(p(v, w, 1) / p(v, w, 0)) for v, w in zip([None, *ws], ws, strict=False)]

    return ratios


def ring_home(points: list[tuple[int, int]], cell: int) -> int:
    """The shard of the first point at or after a cell, clockwise; of points in one cell the least shard."""
    ahead = [(c, s) for s, c in points if c >= cell] or [(c, s) for s, c in points]
    return min(ahead)[1]


def ring_homes(points: list[tuple[int, int]], cells: list[int], shards: int) -> list[int]:
    """How many keys are at home with each shard."""
    homes = Counter(ring_home(points, c) for c in cells)
    return [homes[s] for s in range(shards)]


def ring_loads(points: list[tuple[int, int]], cells: list[int], shards: int) -> tuple[list[int], list[int]]:
    """(loads, homes): keys walk the ring one by one, clockwise from their cell, to the first shard with room."""
    room = [len(cells) // shards + (s < len(cells) % shards) for s in range(shards)]
    arcs = sorted({c: min(s for s, x in points if x == c) for _, c in points}.items())
    load, over = [0] * shards, []
    for cell in sorted(cells):
        home = ring_home(points, cell)
        if load[home] < room[home]:
            load[home] += 1
        else:
            over.append(cell)
    for cell in over:
        at = next((k for k, (c, _) in enumerate(arcs) if c >= cell), 0)
        shard = next((arcs[(at + step) % len(arcs)][1] for step in range(len(arcs)) if load[arcs[(at + step) % len(arcs)][1]] < room[arcs[(at + step) % len(arcs)][1]]), None)
        shard = shard if shard is not None else next(s for s in range(shards) if load[s] < room[s])
        load[shard] += 1
    return load, ring_homes(points, cells, shards)


def quality_verdict(text: str, rules, stop_words: list[str]) -> bool:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = quality_counts(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    values = {
        "mean_word_chars": counts["word_chars"] / n if n else 0,
        "symbols_per_word": counts["n_symbols"] / n if n else 0,
        "bang_words": sum(w.endswith("!") for w in words) / n if n else 0,
        "stop_words": sum(w in stop_words for w in words) / n if n else 0,
        "dup_lines": counts["n_dup_lines"] / len(lines) if lines else 0,
        "upper_chars": len(re.findall("[A-Z]", text)) / counts["word_chars"] if counts["word_chars"] else 0,
    }
    return all((r.least is None or values[r.value] >= r.least) and (r.most is None or values[r.value] <= r.most) for r in rules)


def bootstrapped(texts: dict, min_seeds: int, min_score: float, reach: int) -> dict[object, list[tuple[int, int, int]]]:
    """The spans that contextual bootstrapping adds to the base ones of each text."""
    import regex

    seen, candidates = {}, {}
    for i, text in texts.items():
        base = personal_spans(text)
        token = r"(?<![0-9A-Za-z(])\(?[0-9]++\)?(?:[ ./-]{1,2}\(?[0-9]++\)?)++|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
        spans = [(k, a, b) for k, a, b in base]
        for m in regex.finditer(token, text):
            if len(re.findall("[0-9]", m[0])) < 4 and not re.search("[^@]@[^@]", m[0]):
                continue
            lead = 0 if re.match(r"\([0-9]+\)", m[0]) else len(regex.match(r"[^\p{L}\p{N}+]*", m[0])[0])
            end = m.start() + len(regex.sub(r"[^\p{L}\p{N}]+$", "", m[0]))
            start = m.start() + lead
            if end > start and not any(a < end and start < b for _, a, b in base):
                spans.append((-1, start, end))
        for k, a, b in spans:
            left = re.split(r"[ \t\n\x0b\x0c\r]+", (" " if a <= reach else "") + text[max(a - reach, 0) : a])
            right = re.match(r"[ \t\n\x0b\x0c\r]*([^ \t\n\x0b\x0c\r]+)[ \t\n\x0b\x0c\r]", (text[b : b + reach] + (" " if len(text) <= b + reach else "")).lower())
            left = [w.lower() for w in left[1:] if w]
            patterns = ([f"2:{left[-2]} {left[-1]}"] if len(left) > 1 else []) + ([f"1:{left[-1]}"] if left else []) + ([f"c:{left[-1]} _ {right[1]}"] if left and right else [])
            candidates.setdefault(i, []).append((k, a, b, patterns))
            for p in patterns:
                seen.setdefault(p, {}).setdefault(text[a:b].lower(), set()).add(k)
    seeds: dict[str, set[int]] = {}
    for instances in seen.values():
        for s, kinds in instances.items():
            seeds.setdefault(s, set()).update(kinds - {-1})
    scores = {s: {k: 1.0 for k in kinds} for s, kinds in seeds.items() if kinds}
    accepted, size, trusted = dict(scores), 0, {}
    while True:
        trusted = {}
        for p, instances in seen.items():
            for k in range(4):
                support = [accepted[s][k] for s in instances if accepted.get(s, {}).get(k)]
                if len(support) >= min_seeds and sum(support) / len(instances) >= min_score:
                    trusted[p] = max(trusted.get(p, (0, 0)), (sum(support) / len(instances), k))
        found = {}
        for p, (score, k) in trusted.items():
            for s in seen[p]:
                if s not in scores:
                    found.setdefault(s, []).append((score, k))
        if len(found) <= size:
            break
        size = len(found)
        accepted = scores | {s: {max(x)[1]: sum(y for y, _ in x) / len(x)} for s, x in found.items()}
    return {i: [(max(trusted[p] for p in ps if p in trusted)[1], a, b) for k, a, b, ps in candidates.get(i, []) if k == -1 and any(p in trusted for p in ps)] for i in texts}
