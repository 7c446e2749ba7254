"""Operator 7 [native]: spans proposed by patterns, confirmed by checksums, scored by the words around them.

Only DataFrame and SQL functions. Spark has no function for the places of all matches, so they are summed from the pieces
between the matches: the n-th match starts where the lengths of all pieces and matches before it end. Context comes from the
pieces beside a match, and nothing goes back to the start of a text for a match, so that a text of many matches takes time
in proportion to its length (times the root of the number of its matches, at worst).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut_sizes, free_name, let, others, running

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Code points before and after a span in which its context words are looked for, over this many matches of its kind at most.
NEAR, OVER = 40, 3
#: Added spans (not of the base) count from this score on.
LEAST_SCORE = 0.6


def _luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn checksum."""

    def total(d: Column) -> Column:
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        step = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + step(i)) % 10 == 0

    return let(F.reverse(_digits(m)), total)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters last, letters as 10 to 35."""

    def rest(s: Column) -> Column:
        code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
        step = lambda a, i: F.when(code(i) >= 65, (a * 100 + code(i) - 55) % 97).otherwise((a * 10 + code(i) - 48) % 97)
        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1

    plain = F.replace(m, F.lit(" "), F.lit(""))
    return let(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), rest)


def _accounts(m: Column) -> Column:
    """The account numbers in a run of words: (off, size) of each. One begins and ends with a word and has 15 to 34 characters;
    of those that begin with a word the longest that passes its checksum counts, and the next begins after it. One in 97 longer tries
    passes by chance, so a span may hold words beside the number."""

    def found(words: Column) -> Column:
        def longest(i: Column) -> Column:
            tries = F.transform(F.sequence(F.lit(1), F.least(F.lit(34), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))
            good = F.filter(tries, lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(x))
            return F.coalesce(F.array_max(F.transform(good, lambda x: F.length(x))), F.lit(0))

        def step(a: Column, i: Column) -> Column:
            word = F.element_at(words, i)
            size = F.when((a["at"] >= a["free"]) & word.rlike("^[A-Z]{2}[0-9]{2}"), longest(i)).otherwise(0)

            def put(n: Column) -> Column:
                out = F.when(n > 0, F.concat(a["out"], F.array(F.struct(a["at"].alias("off"), n.alias("size"))))).otherwise(a["out"])
                free = F.when(n > 0, a["at"] + n).otherwise(a["free"])
                return F.struct((a["at"] + F.length(word) + 1).alias("at"), free.alias("free"), out.alias("out"))

            return let(size, put)

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast("array<struct<off:int,size:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(words)), start, step, lambda a: a["out"])

    return let(F.split(m, " ", -1), found)


def _random(m: Column) -> Column:
    """Whether a run of characters looks drawn at random: letters and digits, 10 different ones or more, and a change between
    letters and digits or between cases in every 8 characters or less (names and numbered words change seldom)."""
    mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
    kinds = F.size(F.array_distinct(F.split(F.left(m, F.lit(4 * NEAR)), "")))
    changes = F.regexp_count(m, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])"))
    return mixed & (kinds >= 10) & (8 * changes >= F.length(m))


def _octets(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    return m.rlike(f"^{part}\\.{part}\\.{part}\\.{part}$")


def _n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``needs``: literals, one of which a text must have to match. ``words``: literals, one of which every
    match of ``good`` has: a kind whose own score is too low needs one of them in the text (in lower case). ``good`` and ``bad``: patterns of
    context words (lower case) that add to the score or take from it. ``parts``: (off, size) of the spans within a confirmed
    match, where they may be less than the whole of it."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    base: bool = False
    needs: tuple[str, ...] = ()
    good: str = ""
    bad: str = ""
    words: tuple[str, ...] = ()
    lift: float = field(default=0.4)
    parts: Callable[[Column], Column] | None = None


_X = "[A-Za-z0-9._%+-]"
#: The base kinds, in their order. The patterns accept what the plain ones accept, leftmost and non-overlapping: a match
#: begins where a run of its first class begins, or where the match before it ended, so runs are scanned once and without
#: backtracking, however long they are. Runs of digits too short for a card are not proposed, as its check drops them.
BASE = (
    Kind("email", rf"(?:\G|(?<!{_X})){_X}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, True, ("@",), "e-?mail|contact|write", "example"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7, True, (".",), "\\bip\\b|address|host|server", "version|release"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", lambda m: _n_digits(16, 19)(m) & _luhn(m), 0.8, True, (), "card|visa|credit|payment", "order|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _n_digits(8, 15), 0.7, True, ("+",), "phone|tel|call|mobile|fax", ""),
)
#: Kinds that the method adds. An account number is sure by its checksum, a key by its form; the others need context.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+", lambda m: F.length(m) >= 15, 0.7, good="iban|account|bank", parts=_accounts),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, needs=("-",), good="ssn|social security", bad="order|part", words=("ssn", "social")),
    Kind("card_short", r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])", _luhn, 0.3, good="card|visa|amex|credit", bad="order|serial|isbn", words=("card", "visa", "amex", "credit")),
    Kind("key", r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_])", lambda m: F.lit(True), 0.8, needs=("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ"), good="key|token|secret"),
    Kind("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+", _random, 0.3, good=r"secret|token|passw|\bpwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|\bauth", bad="commit|checksum|digest|sha-?256|md5", words=("secret", "token", "passw", "pwd", "key", "credential", "bearer", "auth")),
    Kind("phone_local", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.3, good="phone|tel\\b|call|mobile|fax", bad="order|part|serial", words=("phone", "tel", "call", "mobile", "fax")),
)


def _proposed(text: Column, low: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind in a text (``low``: in lower case), in order, with scores."""
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            # The ends of pieces and matches are all that context needs of them.
            ends = lambda x, side: F.when(F.length(x) <= NEAR, x).otherwise(side(x))
            last = lambda x: ends(x, lambda y: F.right(y, F.lit(NEAR)))
            first = lambda x: ends(x, lambda y: F.left(y, F.lit(NEAR)))
            sizes = F.transform(found, lambda m, i: F.length(m) + F.length(pieces[i]))
            parts = F.struct(
                running(sizes).alias("at"),
                *(F.transform(x, f).alias(n) for n, x, f in (("pl", pieces, last), ("pf", pieces, first), ("ml", found, last), ("mf", found, first))),
            )

            def spans(z: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    def at(start: Column) -> Column:
                        score = _score(_around(z, i), kind)
                        make = lambda s, e: F.struct(F.lit(kind.name).alias("kind"), s.alias("start"), e.alias("end"), score.alias("score"))
                        if kind.parts:
                            return F.transform(kind.parts(m), lambda x: make(start + x["off"], start + x["off"] + x["size"]))
                        return F.array(make(start, start + F.length(m)))

                    return F.when(kind.check(m), let(z["at"][i] + F.length(pieces[i]), at)).otherwise(none)

                return F.flatten(F.transform(found, one))

            return let(parts, spans)

        return let(F.split(text, kind.pattern, -1), with_pieces)

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
    for has, literals in ((text, kind.needs), (low, kind.words)):
        if literals:
            some = F.contains(has, F.lit(literals[0]))
            for x in literals[1:]:
                some |= F.contains(has, F.lit(x))
            found = F.when(some, found).otherwise(none)
    return found


def _around(z: Column, i: Column) -> Column:
    """The code points before and after the ``i``-th match, in lower case."""
    get = lambda c, j: F.coalesce(F.get(z[c], j), F.lit(""))
    before = F.concat(*(x for j in range(OVER, 0, -1) for x in (get("pl", i - j), get("ml", i - j))), get("pl", i))
    after = F.concat(get("pf", i + 1), *(x for j in range(1, OVER + 1) for x in (get("mf", i + j), get("pf", i + j + 1))))
    return F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit("\n"), F.left(after, F.lit(NEAR))))


def _score(near: Column, kind: Kind) -> Column:
    def adjusted(near: Column) -> Column:
        out = F.lit(kind.score)
        if kind.good:
            out += F.when(near.rlike(kind.good), kind.lift).otherwise(0.0)
        if kind.bad:
            out -= F.when(near.rlike(kind.bad), kind.lift).otherwise(0.0)
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)).cast("double")

    return let(near, adjusted) if kind.good or kind.bad else F.lit(kind.score).cast("double")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, added spans) of a text: arrays of (kind, start, end, score) in code points, ends exclusive, by kind and
    start. Added spans are those of a sufficient score; they may overlap base spans."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*(_proposed(text, text, k) for k in BASE))
    added = let(F.lower(text), lambda low: F.concat(*(_proposed(text, low, k) for k in ADDED)))
    return base, F.filter(added, lambda x: x["score"] >= LEAST_SCORE)


def _apart(added: Column, base: Column) -> Column:
    """The spans of ``added`` that overlap none of ``base``, which is looked through in parts of the root of its length."""

    def free(ordered: Column) -> Column:
        def in_parts(c: Column) -> Column:
            index = F.sequence(F.lit(0), F.ceil(F.size(ordered) / c).cast("int") - 1)
            part = lambda p: F.struct(p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda y: y["end"])).alias("end"), p.alias("spans"))
            parts = F.transform(index, lambda i: let(F.slice(ordered, i * c + 1, c), part))
            meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
            return let(parts, lambda ps: F.filter(added, lambda x: ~F.exists(ps, lambda p: meets(x, p) & F.exists(p["spans"], lambda y: meets(x, y)))))

        return let(cut_sizes(F.size(ordered)), in_parts)

    by_start = F.array_sort(F.transform(base, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))))
    return F.when((F.size(added) == 0) | (F.size(base) == 0), added).otherwise(let(by_start, free))


OUTPUTS = ["base_spans", "added_spans"]


def pii_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and added_spans (see ``find_spans``; added spans that overlap a base span are left out); input columns of
    these names are replaced.

    - A null or empty text has no spans (empty arrays). Texts of any length are scanned whole.
    - Each row is taken by itself: repeated rows and ids give repeated results; an empty table gives an empty one.
    - Spans of different base kinds may overlap (a phone number may hold an address); all stay.
    - Context words count up to ``NEAR`` code points before and after a match, and not beyond the third match beside it.
    """
    base, added = find_spans(F.col(text_col))
    both = let(F.struct(base.alias("b"), added.alias("a")), lambda x: F.struct(x["b"].alias("b"), let(x["a"], lambda a: _apart(a, x["b"])).alias("a")))
    kept, name = others(docs, OUTPUTS), free_name(docs, "spans")
    return docs.select(*kept, both.alias(name)).select(*kept, F.col(f"{name}.b").alias("base_spans"), F.col(f"{name}.a").alias("added_spans"))


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, and the scores of the spans in their order, of each row of ``docs`` (doc_id,
    text)."""
    found = pii_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base_spans", "added_spans")
    return found.select(
        "doc_id",
        *(count(k.name) for k in BASE),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.array_join(F.transform(every, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def _gaps(spans: Column) -> Column:
    """The stretches (start, end, kind) of a text that ``spans`` (by start, of these the longest first) cover, each named by the span
    that starts it."""

    def stretches(reach: Column) -> Column:
        # A stretch begins where a span starts behind the ends of all before it, and ends where those before the next one end.
        heads = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), reach[i].alias("reach")))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        end = lambda h, i: F.coalesce(F.get(h, i + 1)["reach"], last)
        return let(F.filter(heads, lambda h: h["start"] >= h["reach"]), lambda h: F.transform(h, lambda x, i: F.struct(x["start"].alias("start"), end(h, i).alias("end"), x["kind"].alias("kind"))))

    return let(running(F.transform(spans, lambda x: x["end"]), F.greatest), stretches)


def _without(text: Column, gaps: Column) -> Column:
    """``text`` with each of ``gaps`` (not empty) replaced by its kind in brackets; cut in parts of the root of their number first, as
    every cut walks from the start of what it cuts."""

    def in_parts(c: Column) -> Column:
        def part(i: Column) -> Column:
            begin = F.coalesce(F.get(gaps, i * c - 1)["end"], F.lit(0))

            def cut(x: Column) -> Column:
                before = lambda j: F.coalesce(F.get(x["gaps"], j - 1)["end"], x["begin"])
                piece = lambda g, j: F.substring(x["text"], before(j) - x["begin"] + 1, g["start"] - before(j))
                return F.array_join(F.transform(x["gaps"], lambda g, j: F.concat(piece(g, j), F.lit("["), F.upper(g["kind"]), F.lit("]"))), "")

            taken = F.slice(gaps, i * c + 1, c)
            own = let(taken, lambda g: F.struct(g.alias("gaps"), begin.alias("begin"), F.substring(text, begin + 1, F.element_at(g, -1)["end"] - begin).alias("text")))
            return let(own, cut)

        index = F.sequence(F.lit(0), F.ceil(F.size(gaps) / c).cast("int") - 1)
        rest = F.substring(text, F.element_at(gaps, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(index, part), ""), rest)

    return let(cut_sizes(F.size(gaps)), in_parts)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; of overlapping spans the one that starts first
    (of these the longest) names the gap, which covers them all. All other columns are unchanged; a null text stays null."""

    found = pii_spans(docs)
    every = F.concat("base_spans", "added_spans")
    by_start = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("longest"), x["kind"].alias("kind"), x["end"].alias("end"))))
    clean = let(let(by_start, _gaps), lambda g: _without(F.col("text"), g))
    text = F.when(F.size(every) == 0, F.col("text")).otherwise(clean).alias("text")
    return found.select(*(text if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns))
