"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators (Luhn, mod-97, digit counts, octet ranges, the mixture of characters that keys
have) confirm them, and context words nearby raise the score of the weaker kinds.  Positions come from the gaps between matches: the text split by a pattern and
the matches of the pattern, put together again, tell where each match starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import safe

# Quantifiers are possessive and starts are pinned by lookbehind where that finds the same matches: no run of characters is
# scanned twice, and long repeats need no recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single blanks or hyphens between them, if it has 14 digits at least.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9])"
#: A run of the characters of keys and tokens, and one that begins as well-known issuers' keys do.
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
ISSUED = r"(?<![A-Za-z0-9_-])(?:sk-|pk_live_|sk_live_|gh[pousr]_|xox[abprs]-|AKIA|ASIA|AIza|glpat-|eyJ)[A-Za-z0-9_.-]{16,}+"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Code points before and after a span that are searched for context words.
NEAR = 40
SPAN = "struct<start:int,rank:int,stop:int,kind:string,score:double>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Whether the letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda r, c: F.when(c == "", r).when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # a regular expression or character that every text with a match has
    base: bool
    score: float
    context: str = ""

    def valid(self, s: Column) -> Column:
        n = F.length(digits(s))
        match self.name:
            case "ip":
                return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
            case "card":
                return n.between(14, 19) & F.coalesce(F.call_function("luhn_check", F.when(n.between(14, 19), digits(s))), F.lit(False))
            case "phone":
                return n.between(10, 15)
            case "iban":
                return mod97(s)
            case "ssn":
                return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
            case "local_phone":
                return n.between(7, 12)
            case "secret":
                # letters and digits mixed, and at least ten different characters: neither a word nor a number nor a rule
                return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.substr(s, F.lit(1), F.lit(64)), ""))) >= 10)
            case _:
                return F.lit(True)


#: Kinds in the order in which spans of equal start are listed; the first four are the base kinds.
KINDS = (
    Kind("email", EMAIL, "@", True, 1.0),
    Kind("ip", IP, r"[0-9]\.[0-9]", True, 1.0),
    Kind("card", CARD, r"[0-9][\x20-]?[0-9]", True, 1.0),
    Kind("phone", PHONE, "+", True, 1.0),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", False, 0.9),
    Kind("ssn", SSN, r"[0-9]-[0-9]{2}-[0-9]", False, 0.3, r"\b(?:ssn|social security|sozialversicherung|sécurité sociale|seguridad social)"),
    Kind("local_phone", LOCAL, r"[0-9]\)?[\x20.-][0-9]", False, 0.3, r"\b(?:phone|tel|telephone|call|mobile|fax|téléphone|teléfono|telefon)\b"),
    Kind("key", ISSUED, r"sk-|k_live_|gh[pousr]_|xox[abprs]-|A[KS]IA|AIza|glpat-|eyJ", False, 0.9),
    Kind("secret", SECRET, r"[A-Za-z0-9+/_-]{20}", False, 0.3, r"(?:token|secret|passwor[dt]|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|authorization|credential|contraseña|mot de passe)"),
)
CONTEXT_BONUS = 0.4


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of the value, which is computed once however often ``fn`` and lambdas in it use it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def sliced(array: Column) -> Column:
    """The array in slices of about the square root of its length, at least 16; an empty array is one empty slice.

    Appending to an array copies it, so a fold over slices first and over their results next takes n * sqrt(n) steps.
    """
    n = F.size(array)
    step = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda i: F.slice(array, i + 1, step))


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Array of the kind's confirmed spans (code points, end exclusive) with their scores."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,hit:string>>").alias("found"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("stop"), part["hit"].alias("hit"))
        found = F.when(part["hit"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(span)))
        return F.struct(end.alias("at"), found.alias("found"))

    # places within each slice, then the place where each slice begins
    pieces = bound(parts, lambda all_: F.transform(sliced(all_), lambda slice_: F.aggregate(slice_, start, add)))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts_of = lambda p: F.aggregate(p, begun, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])

    def scored(s: Column, piece: Column | None, from_: Column) -> Column:
        score = F.lit(kind.score)
        if piece is not None:
            here = s["start"] - from_
            before = F.substr(piece, F.greatest(here - NEAR, F.lit(0)) + 1, F.least(here, F.lit(NEAR)))
            around = F.lower(F.concat(before, F.lit(" "), F.substr(piece, s["stop"] - from_ + 1, F.lit(NEAR))))
            score = score + F.when(around.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind.name).alias("kind"), score.alias("score"))

    def confirmed(part: Column, by: Column) -> Column:
        moved = F.transform(part["found"], lambda x: F.struct((x["start"] + by).alias("start"), (x["stop"] + by).alias("stop"), x["hit"].alias("hit")))
        valid = F.filter(moved, lambda s: kind.valid(s["hit"]))
        if not kind.context:
            return F.transform(valid, lambda s: scored(s, None, by))
        # the slice's text with what is near, so that no match searches the whole text for its place
        from_ = F.greatest(by - NEAR, F.lit(0))
        return bound(F.substr(text, from_ + 1, part["at"] + 2 * NEAR), lambda piece: F.transform(valid, lambda s: scored(s, piece, from_)))

    found = bound(pieces, lambda p: F.flatten(F.zip_with(p, starts_of(p), confirmed)))
    guard = F.contains(text, F.lit(kind.guard)) if len(kind.guard) == 1 else text.rlike(kind.guard)
    return F.when(guard, found).otherwise(none)


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with pii_base and pii_spans: the base kinds' spans, and all spans scored ``threshold`` or more.

    Spans are structs of start, rank, stop, kind and score, ordered by start and kind.  Base spans always stay; added
    spans of weak kinds that overlap a base span are left out.  Null and empty texts have no spans; each row counts by
    itself; new columns get underscores before them where ``docs`` has such names.  Texts of any length are searched
    whole; n matches take about n * sqrt(n) steps.
    """
    text, base, more, all_ = safe(docs, "pii_text", "pii_base", "pii_more", "pii_spans")
    t = F.col(text)
    found = docs.withColumn(text, F.coalesce("text", F.lit("")))
    parts = {rank: (k, f"{text}_{k.name}") for rank, k in enumerate(KINDS)}
    found = found.withColumns({name: spans_of(t, k, rank) for rank, (k, name) in parts.items()})
    found = found.withColumns(
        {
            base: F.array_sort(F.concat(*(F.col(n) for k, n in parts.values() if k.base))),
            more: F.filter(F.concat(*(F.col(n) for k, n in parts.values() if not k.base)), lambda s: s["score"] >= threshold),
        }
    )
    meets = lambda b, s: (b["start"] < s["stop"]) & (s["start"] < b["stop"])
    blocks = F.transform(
        sliced(F.col(base)), lambda x: F.struct(F.array_min(F.transform(x, lambda b: b["start"])).alias("start"), F.array_max(F.transform(x, lambda b: b["stop"])).alias("stop"), x.alias("spans"))
    )
    free = lambda s, found: ~F.exists(found, lambda x: F.coalesce(meets(x, s), F.lit(False)) & F.exists(x["spans"], lambda b: meets(b, s)))
    clear = bound(blocks, lambda found: F.filter(more, lambda s: (s["kind"] == "iban") | free(s, found)))
    return found.withColumn(all_, F.array_sort(F.concat(F.col(base), clear))).select(*docs.columns, base, all_)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their list, and the list of all spans, for each row."""
    found = find_pii(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(count_of(F.col("pii_base"), k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
    )


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, columns as given; overlapping spans become one.

    Null texts and texts without spans stay as they are; n_chars, where present, follows the text.
    """
    found = find_pii(docs, threshold)
    spans, text = F.col(found.columns[-1]), F.coalesce("text", F.lit(""))
    size = F.length(text)

    def replaced(slices: Column) -> Column:
        """Slices of spans in turn, each within its own piece of the text, from the end of all spans before it."""

        def piece(slice_: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(slice_[0]["start"])
            end = F.coalesce(F.get(slices, i + 1)[0]["start"], size)
            reached = F.coalesce(F.array_max(F.flatten(F.transform(F.slice(slices, 1, i), lambda x: F.transform(x, lambda s: s["stop"])))), F.lit(0))

            def add(state: Column, s: Column, part: Column) -> Column:
                gap = F.substr(part, state["at"] - begin + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
                mark = F.when(s["start"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
                return F.struct(F.greatest(s["stop"], state["at"]).alias("at"), F.concat(state["out"], gap, mark).alias("out"))

            def written(part: Column) -> Column:
                start = F.struct(F.greatest(begin, reached).alias("at"), F.lit("").alias("out"))
                return F.aggregate(slice_, start, lambda state, s: add(state, s, part), lambda s: F.concat(s["out"], F.substr(part, s["at"] - begin + 1)))

            return bound(F.substr(text, begin + 1, end - begin), written)

        return F.array_join(F.transform(slices, piece), "")

    new = {"text": F.when(F.size(spans) > 0, bound(sliced(spans), replaced)).otherwise(F.col("text"))}
    out = found.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
