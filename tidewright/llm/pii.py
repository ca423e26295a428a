"""Personal data: regular expressions propose spans, checksums confirm, context adjusts.

Everything is a DataFrame expression. A text is split by a kind's pattern into the gaps
between its matches; gap and match lengths, summed along the text, give each match's start and
end in code points.
The patterns are written without backtracking over groups (possessive repeats, and a start
that must not lie inside a run), which leaves their matches as they are and keeps the time
linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds. The look-behinds only skip starts inside a
# run from which the same or a longer match has been tried already.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Kinds that this method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Is the digit string ``x`` right by Luhn's checksum?"""
    d = F.filter(F.split(F.reverse(x), ""), lambda c: c != "")
    doubled = F.transform(d, lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod97(x: Column) -> Column:
    """Is the account number ``x`` (blanks allowed) right by the mod-97 checksum?"""
    bare = F.regexp_replace(x, " ", "")
    moved = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def n_digits(x: Column, low: int, high: int) -> Column:
    return F.length(digits(x)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    cue: str  # words nearby that raise the score
    prior: float
    certain: bool = True  # a base kind: kept whatever its score

    def valid(self, x: Column) -> Column:
        if self.name == "ip":
            return x.rlike(OCTETS)
        if self.name == "card":
            return n_digits(x, 13, 19) & F.when(n_digits(x, 13, 19), luhn(digits(x))).otherwise(False)
        if self.name == "phone":
            return n_digits(x, 9, 15)
        if self.name == "iban":
            return mod97(x)
        if self.name == "ssn":
            return ~x.rlike("^(?:000|666|9)") & ~x.rlike("-00-") & ~x.rlike("-0000$")
        return F.lit(True)


# Cue words by kind, priors and the bound for added kinds.
KINDS = (
    Kind("email", EMAIL, r"(?i)e-?mail|contact|mailto|correo|courriel", 0.9),
    Kind("ip", IP, r"(?i)\b(?:ip|host|server|address|adresse)\b", 0.6),
    Kind("card", CARD, r"(?i)card|visa|credit|karte|carte|tarjeta", 0.8),
    Kind("phone", PHONE, r"(?i)phone|call|tel|mobile|fax", 0.7),
    Kind("iban", IBAN, r"(?i)iban|account|konto|compte|cuenta", 0.9, certain=False),
    Kind("ssn", SSN, r"(?i)ssn|social|security", 0.4, certain=False),
)
BASE = KINDS[:4]
CUE_GAIN, LEAST_SCORE, NEAR = 0.3, 0.5, 40
#: Code points of the pieces that a text is rebuilt from.
CHUNK = 1024


def gathered(items: Column, start: dict[str, Column], out: str, step) -> Column:
    """``F.aggregate`` over ``items`` from the state ``start`` to a state that also has ``parts``:
    all that ``step(state, item)`` appends. It returns (next state, item to append, whether).

    Appending to one array copies it each time. Here the items go in runs of about the root of
    their number, each run into an array of its own, so the copying stays far below the square.
    """
    empty, none = F.from_json(F.lit("[]"), f"array<{out}>"), F.from_json(F.lit("[]"), f"array<array<{out}>>")

    def state(parts: Column, **fields: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in fields.items()), parts.alias("parts"))

    def one(acc: Column, item: Column) -> Column:
        fields, value, wanted = step(acc, item)
        more = F.concat(acc["parts"], F.array(value))
        return state(more if wanted is None else F.when(wanted, more).otherwise(acc["parts"]), **fields)

    def one_run(acc: Column, run: Column) -> Column:
        # the array of one state binds the run's result, so that it is made once
        inner = F.aggregate(run, state(empty, **{n: acc[n] for n in start}), one)
        return F.transform(F.array(inner), lambda z: state(F.concat(acc["parts"], F.array(z["parts"])), **{n: z[n] for n in start}))[0]

    def whole(z: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(z))).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), width)
        runs = F.transform(firsts, lambda i: F.slice(z, i, width))
        return F.aggregate(runs, state(none, **start), one_run, lambda acc: state(F.flatten(acc["parts"]), **{n: acc[n] for n in start}))

    return F.transform(F.array(items), whole)[0]


SPAN = "struct<start:int,end:int,hit:string,before:string,after:string>"


def proposed(text: Column, kind: Kind) -> Column:
    """Array of (start, end, hit, before, after): every leftmost non-overlapping match, in code
    points, with up to ``NEAR`` code points on each side.

    What stands before a match is carried along the gaps, and what stands after it is captured
    by a look-ahead, so no match makes the text be read again from its start.
    """
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(f"(?:{kind.pattern})(?=((?s:.{{0,{NEAR}}})))"), F.lit(1))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), after.alias("after"))
    tail = lambda x: F.substring(x, -NEAR, NEAR)

    def step(acc: Column, p: Column):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        before = tail(F.concat(acc["tail"], tail(p["gap"])))
        one = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), before.alias("before"), p["after"].alias("after"))
        return {"at": end, "tail": tail(F.concat(before, p["hit"]))}, one, None

    folded = gathered(pairs, {"at": F.lit(0), "tail": F.lit("")}, SPAN, step)["parts"]
    return F.when(text.rlike(kind.pattern), folded).otherwise(F.from_json(F.lit("[]"), f"array<{SPAN}>"))


def confirmed(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of the proposals that pass; a cue within ``NEAR``
    code points raises the score, and added kinds must reach ``LEAST_SCORE``."""
    passing = F.filter(proposed(text, kind), lambda s: kind.valid(s["hit"]))

    def scored(s: Column) -> Column:
        cue = s["before"].rlike(kind.cue) | s["after"].rlike(kind.cue)
        score = F.lit(kind.prior) + F.when(cue, CUE_GAIN * (1 - kind.prior)).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    out = F.transform(passing, scored)
    return out if kind.certain else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)


def columns_of(kinds: tuple[Kind, ...], taken: list[str], prefix: str = "pii_") -> dict[str, str]:
    """The column of each kind's spans; a name that the caller's table has is refused."""
    names = {k.name: f"{prefix}{k.name}" for k in kinds}
    if clash := sorted({n.lower() for n in names.values()} & {c.lower() for c in taken}):
        raise ValueError(f"the table has columns named {', '.join(clash)}: pass another prefix")
    return names


def find(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` with ``pii_email``, ``pii_ip`` ...: arrays of (kind, start, end, score).

    A null text counts as empty; a text without matches has empty arrays. Other columns stay; a
    column that has one of the new names raises ValueError, and ``prefix`` gives others. Rows are
    independent of each other, so repeated rows have equal arrays and an empty table stays empty.
    """
    names = columns_of(KINDS, docs.columns, prefix)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({names[k.name]: confirmed(body, k) for k in KINDS})


def joined(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end, by kind as listed and then by start, comma-joined."""
    spans = F.concat(*(F.col(f"pii_{k.name}") for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts, the digest of the base
    spans, and all spans of every row.

    A null or empty text, or one without matches, has counts of 0, the digest of the empty string
    and empty spans; very long texts are read whole. Repeated rows and null ids have a row each;
    columns besides doc_id and text, whatever their names, are left out. An empty table gives an
    empty result.
    """
    found = find(docs.select("doc_id", "text"))
    counts = {f"n_{k.name}": F.size(f"pii_{k.name}").cast("long") for k in BASE}
    return found.select(
        "doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"), joined(KINDS).alias("spans")
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """Redacted documents, their n_chars that of the new text (unchanged for null texts); all
    other columns stay, as ``redact`` says."""
    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``[KIND]``; of overlapping spans
    the earliest, and of those the longest, names the replacement, and all are covered. Texts
    without spans, and nulls, stay as they are, and so do all other columns, whatever their
    names. Rows are independent of each other."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = F.array_sort(
        F.transform(F.concat(*(confirmed(body, k) for k in KINDS)), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    )
    chunks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    def rebuilt(z: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            # only the chunks that hold the piece are read
            first, last = F.floor(a / CHUNK).cast("int"), F.floor((F.greatest(b, a + 1) - 1) / CHUNK).cast("int")
            return F.substr(F.array_join(F.slice(z["chunks"], first + 1, last - first + 1), ""), a % CHUNK + 1, F.greatest(b - a, F.lit(0)))

        def step(acc: Column, s: Column):
            piece = F.concat(between(acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return {"at": F.greatest(acc["at"], -s["back"])}, piece, s["start"] >= acc["at"]

        end = F.transform(F.array(gathered(z["spans"], {"at": F.lit(0)}, "string", step)), lambda e: F.concat(F.array_join(e["parts"], ""), between(e["at"], z["n"])))[0]
        return F.when(F.size(z["spans"]) > 0, end)

    # the array of one struct binds chunks and spans, so that they are made once
    once = F.transform(F.array(F.struct(chunks.alias("chunks"), spans.alias("spans"), F.length(body).alias("n"))), rebuilt)[0]
    return docs.withColumn(text, F.coalesce(once, F.col(text)))
