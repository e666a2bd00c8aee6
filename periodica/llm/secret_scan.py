"""Secret scan: three patterns, and Shannon entropy in a sliding window over candidate strings.

All work is column expressions. A pattern's places come from its matches and the
gaps between them, so positions are exact code points.

Entropy spans: a candidate is a run of ``LEAST`` or more token characters with a
letter and a digit. Its character class (hex, base 32, base 64) fixes the alphabet and the
least entropy. A window of ``WINDOW`` characters slides over it; the counts
per character, and the sum of ``c * log2 c`` that the entropy needs, change only by the
character that enters and the one that leaves. The span is reported when the
highest window reaches the class's bound, unless the allow-list knows the string
as a sample, a UUID or a run of the alphabet.

What a pattern span covers is cut out of a candidate first, and each rest is a
candidate of its own, without the ``/`` and ``=`` at its ends. Where the allow-list
knows some of a candidate, the letters and digits between its joints (``/=+_-``)
are judged one by one, so a sample's name beside a key does not hide the key.

Null or empty texts have no spans. Rows are independent: repeated rows repeat
their result, other columns pass through ``scan`` untouched, but for columns that
have the names of its spans, which ``names`` can change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The keywords in either case, what may stand around them, and the value's characters.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

WINDOW, LEAST = 20, 24
#: Character classes: name, pattern of the whole string, alphabet, least bits of a window.
CLASSES = (
    ("entropy-hex", "^[0-9a-f]+$", "0123456789abcdef", 3.0),
    ("entropy-base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 3.4),
    ("entropy-base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
#: Strings that are known to be no secrets.
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0{8}|12345678|abcdefgh"
    "|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))

SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """(value, start, stop) of each match; ``value`` is the group's text."""
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )
    empty = F.array().cast("array<struct<value:string,start:int,stop:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["gap"])).cast("int")
        stop = (start + F.length(x["whole"])).cast("int")
        place = F.struct(x["value"].alias("value"), start.alias("start"), stop.alias("stop"))
        grown = F.struct(stop.alias("at"), F.array_append(acc["out"], place).alias("out"))
        return F.when(x["whole"].isNull(), acc).otherwise(grown)

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, first, step, lambda acc: acc["out"])).otherwise(empty)


def _spans(places: Column, kind: str, least: int) -> Column:
    kept = F.filter(places, lambda p: F.length(p["value"]) >= least)
    return F.transform(kept, lambda p: _span(p, kind)).cast(SPAN)


def _span(p: Column, kind: str | Column) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    rank = F.lit(KINDS.index(kind)) if isinstance(kind, str) else F.array_position(F.lit(list(KINDS)), kind).cast("int") - 1
    return F.struct(p["start"].alias("start"), rank.alias("rank"), p["stop"].alias("stop"), name.alias("kind"))


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, alphabet: str) -> Column:
    """Highest Shannon entropy, in bits, of a window of the text; a shorter text is one window."""
    chars = F.split(text, "")
    places = F.transform(chars, lambda ch: F.instr(F.lit(alphabet), ch))
    pairs = F.arrays_zip(places.alias("enter"), F.concat(F.array_repeat(F.lit(0), WINDOW), places).alias("leave"))
    pairs = F.filter(pairs, lambda p: p["enter"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        # Counts of the entering and the leaving character are read before they change.
        into, out = F.get(acc["counts"], p["enter"]), F.get(acc["counts"], p["leave"])
        same = p["enter"] == p["leave"]
        gain = _weight(into + 1) - _weight(into)
        loss = F.when(p["leave"] > 0, _weight(out) - _weight(out - 1)).otherwise(F.lit(0.0))
        total = F.when(same, acc["total"]).otherwise(acc["total"] + gain - loss)
        held = acc["held"] + F.when(p["leave"] > 0, 0).otherwise(1)
        counts = F.transform(
            acc["counts"], lambda c, i: c + F.when(i == p["enter"], 1).otherwise(0) - F.when((i == p["leave"]) & (i > 0), 1).otherwise(0)
        )
        entropy = F.log2(held.cast("double")) - total / held
        best = F.when(held < F.least(F.lit(WINDOW), acc["size"]), acc["best"]).otherwise(F.greatest(acc["best"], entropy))
        return F.struct(counts.alias("counts"), total.alias("total"), held.alias("held"), acc["size"].alias("size"), best.alias("best"))

    first = F.struct(
        F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("held"),
        F.length(text).alias("size"), F.lit(0.0).alias("best"),
    )
    return F.aggregate(pairs, first, step, lambda acc: acc["best"])


PLACES = "array<struct<value:string,start:int,stop:int>>"


def _place(p: Column, start: Column, stop: Column) -> Column:
    """Part of a place, from ``start`` to ``stop`` of the text."""
    value = F.substring(p["value"], start - p["start"] + 1, stop - start)
    return F.struct(value.alias("value"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def _rests(p: Column, base: Column) -> Column:
    """What sorted ``base`` spans leave of a place; all of it where none overlaps."""
    over = F.filter(base, lambda b: (b["start"] < p["stop"]) & (p["start"] < b["stop"]))
    edges = F.arrays_zip(
        F.concat(F.array(p["start"]), F.transform(over, lambda b: b["stop"])).alias("begin"), F.concat(F.transform(over, lambda b: b["start"]), F.array(p["stop"])).alias("end"))
    # A span inside an earlier one must not open a rest within it.
    parts = F.transform(edges, lambda e, i: F.struct(F.greatest(e["begin"], F.array_max(F.slice(edges["begin"], F.lit(1), i + 1))).alias("begin"), e["end"].alias("end")))
    rests = F.transform(F.filter(parts, lambda e: e["end"] - e["begin"] >= LEAST), lambda e: _place(p, e["begin"], e["end"]))

    def bare(r: Column) -> Column:
        begin = r["start"] + F.length(F.regexp_extract(r["value"], "^[/=]*", 0))
        return _place(p, begin, F.greatest(begin, r["stop"] - F.length(F.regexp_extract(r["value"], "[/=]*$", 0))))

    return F.when(F.size(over) == 0, F.array(p)).otherwise(F.transform(rests, bare)).cast(PLACES)


def _unjoined(p: Column) -> Column:
    """The long runs of letters and digits of a place."""
    return F.transform(_places(p["value"], f"[A-Za-z0-9]{{{LEAST},}}"), lambda q: F.struct(
        q["value"].alias("value"), (p["start"] + q["start"]).cast("int").alias("start"), (p["start"] + q["stop"]).cast("int").alias("stop"))).cast(PLACES)


def _judged(places: Column, base: Column) -> Column:
    """The strings of which each is judged as a whole."""
    rests = F.filter(F.flatten(F.transform(places, lambda p: _rests(p, base))), lambda p: F.length(p["value"]) >= LEAST)
    known = lambda p: p["value"].rlike(ALLOWED)
    return F.flatten(F.transform(rests, lambda p: F.when(known(p), F.filter(_unjoined(p), lambda q: ~known(q))).otherwise(F.array(p).cast(PLACES))))


def _entropy_spans(judged: Column) -> Column:
    """Spans of strings whose entropy is high for their class."""
    def suspicious(p: Column) -> Column:
        v = p["value"]
        high = None
        for _, pattern, alphabet, least in reversed(CLASSES):
            reached = window_entropy(v, alphabet) >= least
            high = reached if high is None else F.when(v.rlike(pattern), reached).otherwise(high)
        return F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), high).otherwise(False)

    def named(p: Column) -> Column:
        kind = F.lit(CLASSES[-1][0])
        for name, pattern, _, _ in reversed(CLASSES[:-1]):
            kind = F.when(p["value"].rlike(pattern), F.lit(name)).otherwise(kind)
        return _span(p, kind)

    return F.transform(F.filter(judged, suspicious), named).cast(SPAN)


def scan(docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("base_spans", "all_spans")) -> DataFrame:
    """``docs`` with its pattern spans and all its spans, each sorted by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(
        _spans(_places(text, ASSIGN, 2), "assign", LEAST_VALUE),
        _spans(_places(text, ACCESS.replace("+", f"{{{LEAST_ACCESS - 4},}}")), "access", LEAST_ACCESS),
        _spans(_places(text, HEX.replace("+", f"{{{LEAST_HEX},}}")), "hex", LEAST_HEX),
    )
    found = docs.withColumn(names[0], F.sort_array(base))
    candidates = _places(text, f"[A-Za-z0-9+/_=-]{{{LEAST},}}")
    return found.withColumn(names[1], F.sort_array(F.concat(F.col(names[0]), _entropy_spans(_judged(candidates, F.col(names[0]))))))


def _joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[redacted]") -> DataFrame:
    """Documents with each span replaced by ``mark`` and ``n_chars`` counted anew; all rows and columns stay.

    Texts without a span, null ones included, are unchanged.
    """
    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        # A span that begins inside the one before only lengthens it.
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    base, spans, clean = (_free(n, docs) for n in ("base_spans", "all_spans", "clean_text"))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    redacted = F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = scan(docs, names=(base, spans)).withColumn(clean, F.when(F.size(spans) > 0, redacted).otherwise(F.col("text")))
    chars = F.when(F.size(spans) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    cols = [F.col(clean).alias(c) if c == "text" else chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return found.select(*cols)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
