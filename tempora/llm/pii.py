"""Personal data: base patterns, and bootstrapped contextual extraction, by DataFrame operations only.

Base spans (e-mail, IP address, card, phone) are the seeds.  Candidates are other words with four digits or an inner @, and
runs of digit groups with single blanks, dots, dashes, slashes or brackets between them.  The whole words around seeds and
candidates are lexical patterns (two words before; the word before; the words on both sides).  Patterns and instances, the
different strings that they surround, form a graph, scored in turns: a pattern's score for a kind is the mean
score of its instances, and it is trusted where that is at least MIN_SCORE and MIN_SEEDS of them are accepted for that kind.  A
candidate with a trusted pattern is accepted, with the mean score of its trusted patterns.  So accepted candidates support patterns
of their own in the next turn, until a turn accepts nothing new.  Seeds stay 1.

A text is matched in place; only occurrences (spans with a few words of context) are shuffled.  Edges are different
(pattern, instance) pairs, so a group of copies weighs once; patterns that have fewer than MIN_SEEDS instances can never
be trusted and are left out.  Trusted patterns and accepted instances are broadcast up to MAX_BROADCAST rows, checked.

The expressions are those of the base, written so that a long run without a match is passed once.

Cases: null text is the empty text, without spans; offsets are code points; a very long text is matched whole, in time that grows
little faster than its matches; a word of context longer than REACH characters, or not wholly within as many, makes no pattern; repeated rows
are answered one by one and weigh once; of patterns that tie, the later kind of KINDS counts; an empty table gives an empty
result; other columns, whatever their names, pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import materialise, small, table, text_or_empty
from tempora.llm.quality_rules import bind

KINDS = ("email", "ip", "card", "phone")
#: Accepted instances that a pattern needs, its least score, and turns at most: each accepts one more, so it is only a stop.
MIN_SEEDS, MIN_SCORE, TURNS = 5, 0.8, 30
#: Characters of context that are looked at on each side.
REACH = 160
#: Rows of patterns or instances (up to 300 bytes each) that are broadcast at most.
MAX_BROADCAST = 100_000
#: Matches of one text that are placed together, and characters of a text that are looked up together.
_RUN, _BLOCK = 128, 1024
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NO_SPANS = "array<struct<start:int,end:int,s:string>>"


def located(text: Column, regex: str, guard: Column, valid: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, s>>: the matches of a regex, leftmost and non-overlapping, that are valid; end exclusive."""
    none = F.array().cast(_NO_SPANS)
    both = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"), F.split(text, regex, -1).alias("gaps"))

    def length(b: Column, i: Column) -> Column:
        return F.char_length(F.get(b["gaps"], i)) + F.char_length(F.get(b["found"], i))

    def walk(b: Column) -> Column:
        n = F.size(b["found"])
        last = F.floor((n - 1) / _RUN).cast("int")

        def inside(first: Column, at: Column) -> Column:
            """The spans of one run of matches, the first of which comes after the gap at `at`."""

            def step(state: Column, i: Column) -> Column:
                start = (state["at"] + F.char_length(F.get(b["gaps"], i))).cast("int")
                match = F.get(b["found"], i)
                return bind(
                    F.struct(start.alias("start"), (start + F.char_length(match)).cast("int").alias("end"), match.alias("s")),
                    lambda x: F.struct(x["end"].alias("at"), F.when(valid(x["s"]), F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out")),
                )

            return F.aggregate(F.sequence(first, F.least(first + _RUN, n) - 1), F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

        # the place of each run first, as a sum of lengths; then the runs, each by itself, so that no array is copied a match
        total = lambda k: F.aggregate(F.sequence(k * _RUN, k * _RUN + _RUN - 1), F.lit(0), lambda s, i: (s + length(b, i)).cast("int"))
        place = lambda ats, k: F.concat(ats, F.array((F.element_at(ats, -1) + total(k)).cast("int")))
        places = F.when(last == 0, F.array(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), F.array(F.lit(0)), place))
        runs = F.flatten(F.transform(places, lambda at, k: inside((k * _RUN).cast("int"), at)))
        return F.when(n == 0, none).otherwise(runs)

    return F.when(guard, bind(both, walk)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d
        return (total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _card(s: Column) -> Column:
    digits = F.regexp_replace(s, "[ -]", "")
    return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))


def base_spans(text: Column) -> list[Column]:
    """The base spans of each kind, in the order of KINDS."""
    local, host = "A-Za-z0-9._%+-", "[A-Za-z0-9-]"
    return [
        located(text, rf"(?:\G|(?<![{local}]))[{local}]++@{host}++(?:\.{host}++)++", F.contains(text, F.lit("@")), lambda s: F.lit(True)),
        located(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", text.rlike(r"[0-9]\.[0-9]"), lambda s: s.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
        located(text, r"[0-9]++(?:[ -][0-9]++)*+", text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _card),
        located(text, r"\+[0-9][ ().0-9-]+[0-9]", F.contains(text, F.lit("+")), lambda s: F.char_length(F.regexp_replace(s, "[^0-9]", "")).between(8, 15)),
    ]


def other_tokens(text: Column) -> Column:
    """Spans of what looks like an identifier, without the punctuation around it: words with four digits or an @ inside, and runs of digit groups."""
    space = r"\x20\x09-\x0D"
    run = r"(?<![0-9A-Za-z(])\(?[0-9]++\)?(?:[ ./-]{1,2}\(?[0-9]++\)?)++"
    tokens = located(text, rf"{run}|(?<![^{space}])[^{space}0-9@]*+[0-9@][^{space}]*+", text.rlike("[0-9@]"), lambda s: s.rlike(r"(?:[0-9][^0-9]*){4}|[^@]@[^@]"))
    lead = lambda x: F.char_length(F.regexp_extract(x["s"], r"^(?!\([0-9]+\))[^\p{L}\p{N}+]*", 0))
    core = lambda x: F.regexp_extract(x["s"], r"^(?:(?=\([0-9]+\))|[^\p{L}\p{N}+]*)(.*?)[^\p{L}\p{N}]*$", 1)
    return F.transform(tokens, lambda x: F.struct((x["start"] + lead(x)).cast("int").alias("start"), (x["start"] + lead(x) + F.char_length(core(x))).cast("int").alias("end"), core(x).alias("s")))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, tokens): base spans of all kinds and other tokens, each with its context."""
    text = F.col("text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = rows.select("doc_id", "text", *[x.alias(k) for k, x in zip(KINDS, base_spans(text), strict=True)])
    labelled = F.concat(*[F.transform(k, _of_kind(i)) for i, k in enumerate(KINDS)])
    rows = rows.select("doc_id", "text", F.char_length("text").alias("length"), labelled.alias("spans"))
    # spans by the blocks of the text that they touch, so that a candidate is held against those near it only
    at = lambda place: F.floor(place / _BLOCK).cast("int")
    touching = lambda i: F.filter("spans", lambda y: (at(y["start"]) <= i) & (at(y["end"] - 1) >= i))
    rows = rows.withColumn("near", F.when(F.size("spans") > 0, F.transform(F.sequence(F.lit(0), at(F.col("length"))), touching)))
    close = lambda x: F.slice("near", at(x["start"]) + 1, at(x["end"] - 1) - at(x["start"]) + 1)
    apart = lambda x: F.col("near").isNull() | ~F.exists(close(x), lambda ys: F.exists(ys, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    tokens = bind(other_tokens(text), lambda t: F.transform(F.filter(t, lambda x: (x["end"] > x["start"]) & apart(x)), _of_kind(-1)))
    rows = rows.select("doc_id", "text", "length", "spans", F.when(text.rlike("[0-9@]"), tokens).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,s:string>>")).alias("tokens"))
    # looked up in blocks, as each part of a long text is counted from its start; a blank stands for the text's edge, so that a
    # word counts only where both of its ends are seen
    rows = rows.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor(F.col("length") / _BLOCK).cast("int")), lambda i: F.substr(text, i * _BLOCK + 1, F.lit(_BLOCK))))
    block = lambda at, more: F.coalesce(F.get("blocks", F.floor(at / _BLOCK).cast("int") + more), F.lit(""))
    inside = lambda at: (at % _BLOCK).cast("int")
    edge = lambda reached: F.when(reached, F.lit(" ")).otherwise(F.lit(""))
    before = lambda x: F.concat(edge(x["start"] <= REACH), F.right(F.concat(block(x["start"], -1), F.left(block(x["start"], 0), inside(x["start"]))), F.lit(REACH)))
    after = lambda x: F.concat(F.substr(F.concat(block(x["end"], 0), block(x["end"], 1)), inside(x["end"]) + 1, F.lit(REACH)), edge(F.col("length") <= x["end"] + REACH))
    context = lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["s"]).alias("instance"), F.lower(before(x)).alias("before"), F.lower(after(x)).alias("after")
    )
    return rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), F.transform(F.concat("spans", "tokens"), context).alias("seen")
    )


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a context: two words before, the word before, and the words on both sides."""
    left2 = F.regexp_extract(before, r"\s(\S+\s+\S+)\s*$", 1)
    left1 = F.regexp_extract(before, r"\s(\S+)\s*$", 1)
    right1 = F.regexp_extract(after, r"^\s*(\S+)\s", 1)
    some = lambda name, value, *need: F.when(F.concat(*need) != "", F.concat(F.lit(name), value))
    return F.array_compact(F.array(some("2:", F.regexp_replace(left2, r"\s+", " "), left2), some("1:", left1, left1), F.when((left1 != "") & (right1 != ""), F.concat(F.lit("c:"), left1, F.lit(" _ "), right1))))


def confident_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind, score) of the patterns that are trusted in the end, from occurrences (kind or -1, instance, pattern)."""
    kinds = range(len(KINDS))
    edges = seen.groupBy("pattern", "instance").agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"e{k}") for k in kinds])
    # a seed anywhere is a seed for all its patterns
    seeds = edges.groupBy("instance").agg(*[F.max(f"e{k}").alias(f"i{k}") for k in kinds]).where(F.greatest(*[f"i{k}" for k in kinds]) > 0)
    often = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_SEEDS)
    edges = materialise(edges.select("pattern", "instance").join(small(often, MAX_BROADCAST), "pattern"), "pii-edges")
    seeds = materialise(seeds, "pii-seeds")
    accepted, before, trusted = seeds, 0, None
    for _ in range(TURNS):
        supported = edges.join(small(accepted, MAX_BROADCAST), "instance").groupBy("pattern").agg(F.max("size").alias("size"), *[F.sum(f"i{k}").alias(f"s{k}") for k in kinds], *[F.count_if(F.col(f"i{k}") > 0).alias(f"c{k}") for k in kinds])
        scores = [F.when(F.col(f"c{k}") >= MIN_SEEDS, F.struct((F.col(f"s{k}") / F.col("size")).alias("score"), F.lit(k).alias("kind"))) for k in kinds]
        trusted = supported.select("pattern", F.array_max(F.array_compact(F.array(*scores))).alias("best")).where(F.col("best.score") >= MIN_SCORE)
        trusted = materialise(trusted.select("pattern", F.col("best.kind").alias("kind"), F.col("best.score").alias("score")), "pii-trusted")
        found = edges.join(small(trusted, MAX_BROADCAST), "pattern").join(small(seeds, MAX_BROADCAST).select("instance"), "instance", "left_anti")
        found = found.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best"), F.avg("score").alias("mean"))
        found = materialise(found.select("instance", *[F.when(F.col("best.kind") == k, F.col("mean")).otherwise(0.0).alias(f"i{k}") for k in kinds]), "pii-found")
        size = found.count()
        if size <= before:
            break
        accepted, before = seeds.unionByName(found), size
    return trusted


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, base, added): base spans and discovered spans, array<struct<kind, start, end>>, for each row of documents."""
    rows = materialise(scan(documents), "pii-scan")
    seen = rows.where(F.size("seen") > 0).select("doc_id", "text_hash", F.explode("seen").alias("x")).select("doc_id", "text_hash", "x.*")
    seen = seen.select("doc_id", "text_hash", "kind", "start", "end", "instance", F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern"))
    seen = materialise(seen, "pii-occurrences")
    trusted = confident_patterns(seen.select("kind", "instance", "pattern"))
    new = seen.where("kind = -1").drop("kind").join(small(trusted, MAX_BROADCAST), "pattern").groupBy("doc_id", "text_hash", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    added = new.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added"))
    same = F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_hash") == F.col("a.text_hash"))
    joined = rows.select("doc_id", "text_hash", "spans").alias("r").join(added.alias("a"), same, "left")
    return joined.select("r.doc_id", F.col("spans").alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("added"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, from what find gives."""
    counts = [_count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    return digest(find(table(spark, sf_dir, "documents")))
