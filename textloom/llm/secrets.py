"""Secrets: fixed patterns, then stretches of high entropy.

Base spans come from three patterns. Further candidates are long runs of characters (hex digits;
letters, digits and +/_=-) without what the allow list explains. A window slides over each whole run,
however long. The counts of its characters are kept in a few longs, five bits for each character, and
its Shannon entropy follows from the counts of the character that enters and the one that leaves.
Windows above the threshold of their own character class form spans, one for each unbroken stretch.
Only DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import find_spans, let, spans_text, texts

BASE = ["assign", "access", "hex"]
KINDS = BASE + ["entropy_hex", "entropy_mixed"]
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
WINDOW = 20
MIXED = "A-Za-z0-9+/_=-"
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
#: (what looks random but is not secret, its length)
ALLOWED = [(UUID, 36), (r"sha1-[A-Za-z0-9+/]{27}=", 33), (r"sha256-[A-Za-z0-9+/]{43}=", 51), (r"sha512-[A-Za-z0-9+/]{86}==", 95), ("placeholder", 11), ("changeme|abcdefgh|01234567|12345678", 8), ("example", 7), ("sample|x{6}", 6), ("dummy", 5)]


#: The characters of candidate runs by class: a character's place in their concatenation is its counter.
SYMBOLS = [("ends", "0189"), ("digits", "234567"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("marks", "+/_=-")]
ALPHABET = "".join(chars for _, chars in SYMBOLS)
#: Five bits count up to the window's 20; a long holds twelve counters.
BITS, PER = 5, 12
WORDS = -(-len(ALPHABET) // PER)


def _has(counts: Column, *names: str) -> Column:
    """Whether a window has characters of these classes; counts packs the count of each class."""
    mask = sum(31 << (BITS * k) for k, (n, _) in enumerate(SYMBOLS) if n in names)
    return counts.bitwiseAND(F.lit(mask)) != 0


def hex_bits(c: Column) -> Column:
    """The bits that a window of hex digits must exceed; only digits or only letters never do."""
    return F.when(_has(c, "ends", "digits") & _has(c, "upper", "lower"), 3.0).otherwise(9.0)


def mixed_bits(c: Column) -> Column:
    """The bits that a window must exceed, by its class: about one in a hundred random windows with a digit of one
    of the first four classes has no more. Without a digit, words reach 3.8 and paths 3.9."""
    digit, cased, marks = _has(c, "ends", "digits"), _has(c, "upper") & _has(c, "lower"), _has(c, "marks")
    base32 = ~_has(c, "ends", "lower", "marks")
    one_case = ~marks & ~cased
    return F.when(digit & base32, 3.3).when(digit & one_case, 3.4).when(digit & cased, 3.6).when(digit | cased | one_case, 3.9).otherwise(4.1)


#: (class, bits that a window of that class must exceed)
CLASSES = [("0-9A-Fa-f", hex_bits), (MIXED, mixed_bits)]


def unexplained(text: Column) -> Column:
    """The text with blanks over what the allow list explains, so that runs end there; positions stay."""
    out = text
    for pattern, n in ALLOWED:
        out = F.regexp_replace(out, "(?i)" + pattern, " " * n)
    return F.when(text.rlike(rf"(?<![{MIXED}])[{MIXED}]{{{WINDOW}}}"), out).otherwise(text)


def _symbols(run: Column) -> Column:
    """Each character as (long, shift, step, cls): which long counts it, at which bit and by what step, and the step of its class's count."""
    edges, at = [], 0
    for _, chars in SYMBOLS:
        at += len(chars)
        edges.append(at)

    def one(ch: Column) -> Column:
        def placed(i: Column) -> Column:
            cls = F.when(i < edges[0], 1)
            for k, edge in enumerate(edges[1:], 1):
                cls = cls.when(i < edge, 1 << (BITS * k))
            shift = (i % PER * BITS).cast("int")
            step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
            return F.struct(F.floor(i / PER).cast("int").alias("long"), shift.alias("shift"), step.alias("step"), cls.cast("long").alias("cls"))

        return let(F.instr(F.lit(ALPHABET), ch) - 1, placed)

    return F.transform(F.split(run, ""), one)


def high_entropy(run: Column, bits: float | Callable[[Column], Column], window: int = WINDOW) -> Column:
    """Spans (lo, hi) of the run: the unions of overlapping or touching windows that exceed the bits (a function gives those of each window).

    With c the count of each character in a window of w, the entropy is log2(w) - sum(c log2 c) / w. One
    fold over the characters: each step counts one in and one out, reads the counters of these two only,
    and costs the same however long the run is. The window is at most 31 characters.
    """
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    no_symbol = F.struct(F.lit(-1).alias("long"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("cls"))

    def count(longs: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(longs, x["long"]), x["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def folded(symbols: Column) -> Column:
        def step(acc: Column, x: Column, i: Column) -> Column:
            gone = F.when(i >= window, F.get(symbols, i - window)).otherwise(no_symbol)

            def moved(y: Column) -> Column:
                left = F.when(i >= window, count(acc["longs"], y)).otherwise(0)
                came = count(acc["longs"], x) - F.when((x["long"] == y["long"]) & (x["step"] == y["step"]), 1).otherwise(0)
                change = F.when(left > 0, F.get(plogp, left - 1) - F.get(plogp, left)).otherwise(0.0)
                total = acc["total"] + change + let(came, lambda n: F.get(plogp, n + 1) - F.get(plogp, n))
                longs = F.transform(acc["longs"], lambda v, k: v + F.when(k == x["long"], x["step"]).otherwise(F.lit(0).cast("long")) - F.when(k == y["long"], y["step"]).otherwise(F.lit(0).cast("long")))
                return let(F.struct(total.alias("total"), longs.alias("longs"), (acc["cls"] + x["cls"] - y["cls"]).alias("cls")), lambda s: marked(acc, s, i))

            return let(gone, moved)

        def marked(acc: Column, s: Column, i: Column) -> Column:
            most = bits(s["cls"]) if callable(bits) else F.lit(bits)
            ok = (i >= window - 1) & (s["total"] < (F.lit(math.log2(window)) - most) * window - 1e-9)
            lo, apart = i - window + 1, (i - window + 1 > acc["hi"]) & (acc["lo"] >= 0)
            done = F.when(ok & apart, F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))).otherwise(acc["done"])
            start = F.when(ok & (apart | (acc["lo"] < 0)), lo).otherwise(acc["lo"])
            return F.struct((i + 1).alias("i"), s["total"].alias("total"), s["longs"].alias("longs"), s["cls"].alias("cls"), start.alias("lo"), F.when(ok, i + 1).otherwise(acc["hi"]).alias("hi"), done.alias("done"))

        zero = F.lit(0).cast("long")
        first = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("total"), F.array(*[zero] * WORDS).alias("longs"), zero.alias("cls"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("done"))
        finish = lambda a: F.when(a["lo"] >= 0, F.concat(a["done"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))).otherwise(a["done"])
        return F.aggregate(symbols, first, lambda acc, x: step(acc, x, acc["i"]), finish)

    return F.when(F.length(run) >= window, let(_symbols(run), folded)).otherwise(none)


def base_spans(text: Column) -> Column:
    assign = F.filter(find_spans(text, 0, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    access = find_spans(text, 1, ACCESS, lambda m: F.length(m) >= 20)
    return F.array_sort(F.concat(assign, access, find_spans(text, 2, HEX)))


def entropy_spans(text: Column, kind: int, chars: str, bits: Callable[[Column], Column]) -> Column:
    """Spans of one class over whole runs of 20 or more of its characters."""
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def one(x: Column) -> Column:
        return F.transform(high_entropy(x["m"], bits), lambda r: F.struct((x["s"] + r["lo"]).alias("s"), F.lit(kind).alias("k"), (x["s"] + r["hi"]).alias("e")))

    return let(find_spans(text, kind, rf"[{chars}]{{{WINDOW},}}+"), lambda runs: F.when(F.size(runs) == 0, none).otherwise(F.flatten(F.transform(runs, one))))


def outside(spans: Column, others: Column, kind: int) -> Column:
    """The parts of the spans (disjoint, of one kind) that no other span covers: one fold over all starts and ends in order."""
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    ends = lambda a, own: F.flatten(F.transform(a, lambda x: F.array(*[F.struct(p.alias("p"), F.lit(d if own else 0).alias("own"), F.lit(0 if own else d).alias("other")) for p, d in ((x["s"], 1), (x["e"], -1))])))

    def step(acc: Column, e: Column) -> Column:
        bare = (acc["own"] > 0) & (acc["other"] == 0) & (e["p"] > acc["at"])
        parts = F.when(bare, F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("s"), F.lit(kind).alias("k"), e["p"].alias("e"))))).otherwise(acc["parts"])
        return F.struct(e["p"].alias("at"), (acc["own"] + e["own"]).alias("own"), (acc["other"] + e["other"]).alias("other"), parts.alias("parts"))

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("own"), F.lit(0).alias("other"), none.alias("parts"))
    swept = F.aggregate(F.array_sort(F.concat(ends(spans, True), ends(others, False))), first, step, lambda a: a["parts"])
    return F.when(F.size(spans) == 0, none).otherwise(swept)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row, in one scan without a shuffle.

    Of entropy spans the parts outside base spans are kept, and of mixed ones the parts outside hex ones too.
    Null and empty texts have no spans; repeated rows give repeated results.
    """
    text = F.col("text")
    plain = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    df = texts(docs).select("doc_id", "text", unexplained(text).alias("open"))
    df = df.select("doc_id", plain(base_spans(text)).alias("base"), *[entropy_spans(F.col("open"), len(BASE) + i, chars, bits).alias(f"x{i}") for i, (chars, bits) in enumerate(CLASSES)])
    df = df.withColumn("hex", outside(F.col("x0"), F.col("base"), len(BASE))).withColumn("mixed", outside(F.col("x1"), F.concat("base", "x0"), len(BASE) + 1))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(spans_text(F.col("base"), BASE), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "hex", "mixed")), KINDS).alias("spans"),
    )
