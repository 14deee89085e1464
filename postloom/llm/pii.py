"""Personal data: base patterns, and identifiers found by contexts bootstrapped from them.

Base spans seed the bootstrap. The words around a seed are patterns (the word before; the two words before; the words before
and after); every identifier-like token that is no base span occurs in patterns of the same forms. Spark scores the graph
of (pattern, instance) edges in rounds: a pattern's confidence for a kind is the mean score of its instances (one more in the
denominator), an instance's score is the chance that one of its patterns is right. Instances that confident patterns with
enough seeds agree on become spans of that kind.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import kept, map_text, row_key

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SURE = 0.9
SEEDS = 5            # distinct seeds a pattern needs
CONTEXT = 96         # characters on either side in which the words next to a span are sought

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_RUN = re.compile(r"(?<!\w)[0-9]++(?:[ .()-]{1,3}[0-9]++)+(?!\w)")
_DIGITS = re.compile(r"[0-9]+")
_LENGTHS = {"card": (12, 19), "phone": (8, 15)}
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        numbers, at = chain[0].split("."), chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start. Each kind is one pass, leftmost and without overlap."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _contexts(text: str, a: int, b: int) -> list[str]:
    before = _WORD.findall(text[max(0, a - CONTEXT):a].lower())
    after = _WORD.findall(text[b:b + CONTEXT].lower())
    left, right = (before[-1] if before else "^"), (after[0] if after else "$")
    return [f"{left}|", f"{before[-2] if len(before) > 1 else '^'} {left}|", f"{left}|{right}"]


def _could_be(token: str) -> list[str]:
    """The kinds an identifier-like token has the shape of."""
    digits = sum(c.isdigit() for c in token)
    kinds = ["email"] if "@" in token[1:-1] else []
    kinds += ["ip"] if token.count(".") >= 3 and digits >= 4 else []
    kinds += ["card"] if 12 <= digits <= 19 and digits * 4 >= len(token) * 3 else []
    return kinds + (["phone"] if 8 <= digits <= 15 and digits * 3 >= len(token) * 2 else [])


def _parts(groups: list[tuple[int, int]], least: int, most: int) -> list[list[tuple[int, int]]]:
    """Neighbouring groups of digits as numbers of `least` to `most` digits: all, or cut into parts as even as the groups allow."""
    sums = [0]
    for a, b in groups:
        sums.append(sums[-1] + b - a)
    n = -(-sums[-1] // most)
    out, first = [], 0
    while first < len(groups):
        last, aim = first + 1, sums[first] + (sums[-1] - sums[first]) / max(1, n - len(out))
        while last < len(groups) and sums[last + 1] - sums[first] <= most and abs(sums[last + 1] - aim) <= abs(sums[last] - aim):
            last += 1
        if least <= sums[last] - sums[first] <= most:
            out.append(groups[first:last])
        first = last
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(text: str, covered: list[tuple[int, int]], known: dict[str, list[tuple[int, int]]]):
    """(kind, first, behind) of digits in several groups outside `covered` and, by kind, outside the tokens `known` already."""
    edges = [0, *[x for span in covered for x in span], len(text)]
    for start, stop in zip(edges[::2], edges[1::2]):
        for m in _RUN.finditer(text, start, max(start, stop)):
            groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
            for kind, (least, most) in _LENGTHS.items():
                open_: list[list[tuple[int, int]]] = [[]]
                at = bisect_right(known[kind], (m.start(), len(text))) - 1
                near = known[kind][max(0, at):bisect_right(known[kind], (m.end(), 0))]
                k = 0
                for g in groups:
                    while k < len(near) and near[k][1] <= g[0]:
                        k += 1
                    if k < len(near) and near[k][0] < g[1]:
                        open_.append([])
                    else:
                        open_[-1].append(g)
                for part in (p for gs in open_ for p in _parts(gs, least, most) if len(p) > 1):
                    a, b = part[0][0], part[-1][1]
                    if a > start and text[a - 1] == "(" and 0 <= text.find(")", a, b) and text.count("(", a, b) < text.count(")", a, b):
                        a -= 1
                    if a > start and text[a - 1] == "+":
                        a -= 1
                    yield kind, a, b


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, identifier-like tokens and runs of digit groups with their contexts."""
    out, covered = [], sorted((a, b) for _, a, b in base)
    for kind, a, b in base:
        out.append({"kind": kind, "seed": True, "a": a, "b": b, "token": text[a:b], "patterns": _contexts(text, a, b)})
    k, known = 0, {kind: [] for kind in KINDS}
    for m in _TOKEN.finditer(text) if _DIGIT.search(text) or "@" in text else ():
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] < m.end():
            continue
        token = m[0].strip(".,;:!?()[]{}<>\"'`")
        a = m.start() + m[0].find(token)
        for kind in _could_be(token) if token else ():
            known[kind].append((a, a + len(token)))
            out.append({"kind": kind, "seed": False, "a": a, "b": a + len(token), "token": token, "patterns": _contexts(text, a, a + len(token))})
    for kind, a, b in _runs(text, _joined(covered), known) if _DIGIT.search(text) else ():
        out.append({"kind": kind, "seed": False, "a": a, "b": b, "token": text[a:b], "patterns": _contexts(text, a, b)})
    return out


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    ddl = ("doc_id long, k1 long, k2 long, base array<struct<kind: string, a: bigint, b: bigint>>, "
           "seen array<struct<kind: string, seed: boolean, a: bigint, b: bigint, token: string, patterns: array<string>>>")

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            bases, seen = [], []
            for value in piece.column("text"):
                t = value.as_py() or ""
                base = base_spans(t)
                bases.append([{"kind": k, "a": a, "b": b} for k, a, b in base])
                seen.append(occurrences(t, base))
            return {"doc_id": piece.column("doc_id"), "k1": piece.column("k1"), "k2": piece.column("k2"), "base": bases, "seen": seen}
        return work

    k1, k2 = row_key([text])
    return map_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2")), "text", ddl, make)


def confident_instances(edges: DataFrame, *, rounds: int = ROUNDS, sure: float = SURE, seeds: int = SEEDS) -> DataFrame:
    """kind, instance of the tokens that confident patterns agree on. `edges`: kind, pattern, instance, seed, one row each."""
    score = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        known = edges.join(score, ["kind", "instance"])
        patterns = known.groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if("seed").alias("seeds"))
        good = patterns.filter((F.col("seeds") >= seeds) & (F.col("confidence") > 0.5))
        by = edges.filter(~F.col("seed")).join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("new"), F.max("confidence").alias("best"))
        score = kept(score.join(by, ["kind", "instance"], "left").select(
            "kind", "instance", F.greatest("score", F.coalesce("new", F.lit(0.0))).alias("score"), F.coalesce("best", F.lit(0.0)).alias("best")), "pii-scores")
        last, score = score, score.select("kind", "instance", "score")
    return last.filter((F.col("score") >= sure) & (F.col("best") >= sure)).select("kind", "instance")


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, sure: float = SURE, seeds: int = SEEDS) -> DataFrame:
    """doc_id, base, spans per row of `docs`; both array<struct<kind, a, b>> in code points, by kind as listed, then start.

    `spans` holds all base spans and those the bootstrap adds. Null and empty texts have none; equal rows stay, with equal
    spans; with too few seeds nothing is added; an empty table gives none. Whole texts are read, once.
    """
    scanned = kept(_scan(docs, doc_id, text), "pii-scan")
    seen = scanned.select("k1", "k2", F.explode("seen").alias("o")).select("k1", "k2", "o.*").withColumn("instance", F.xxhash64("token"))
    edges = kept(seen.select("kind", "instance", "seed", F.explode("patterns").alias("p")).groupBy(
        "kind", F.xxhash64("p").alias("pattern"), "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    sure_ones = confident_instances(edges, rounds=rounds, sure=sure, seeds=seeds)
    added = seen.filter(~F.col("seed")).join(sure_ones, ["kind", "instance"]).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("kind", "a", "b")).alias("added"))  # of one text
    joined = scanned.select("doc_id", "k1", "k2", "base").join(added, ["k1", "k2"], "left")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    order = F.transform(F.coalesce(F.concat("base", "added"), "base"), lambda s: F.struct(
        F.element_at(rank, s["kind"]).alias("r"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b")))
    return joined.select("doc_id", "base", spans.alias("spans"))
