"""Surrogates for personal data: keyed, type-consistent, distinct and the same wherever an entity occurs.

Entities are found by format: e-mail, phone, card, IBAN, social security number, IPv4, IPv6, MAC, access
keys and passwords, and names of persons (a title or a known given name before capitalised words). A
surrogate is drawn from a keyed hash of the entity's canonical form and poured into the format found:
separators, case, script, country code, card network and check digits stay right; names keep gender and
script. Family and given names map each on their own, so later mentions of a name in the same text get the
same surrogate, and an address or number written in two ways is one entity.

All distinct entities are collected in a table (never on the driver); a surrogate that is also drawn by a
smaller entity, or that is a real entity of the corpus, is drawn again with the next attempt number, until
none collides; from the fifth draw on surrogates get longer, so even one-letter addresses find one. Texts are then replaced in place; only entities with a later attempt, which random draws make
rare, are joined to their documents.

Null text stays null, empty text empty, and text without entities is unchanged. Rows are independent but for
the table of entities, so repeated rows get equal results. The key is a parameter or a setting, and required;
without it surrogates can't be linked to entities.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import by_batch, table
from wakeline.sources.scratch import materialize

#: Setting that holds the key.
KEY_SETTING = "spark.wakeline.surrogateKey"
#: From this attempt on a surrogate gets longer with each draw, so that short formats don't run out of surrogates;
#: formats of fixed length (addresses of machines) have 2^32 of them and more. No entity is drawn more often than this.
WIDER_FROM, MOST_ATTEMPTS = 4, 60

#: Titles and given names by gender.
TITLES = {
    "f": "Mrs Ms Miss Frau Sra Señora Srta Mme Madame Mlle Signora г-жа госпожа",
    "m": "Mr Herr Sr Señor Monsieur Signor г-н господин",
    "x": "Dr Prof Mx доктор",
}
GIVEN = {
    "f": "Anna Maria Sarah Laura Julia Emma Sofia Elena Olivia Emily Jessica Jennifer Elizabeth Susan Linda Patricia Claudia "
    "Katharina Sabine Ursula Isabelle Camille Juliette Carmen Lucía Ana Мария Анна Елена Ольга Наталья Татьяна",
    "m": "John James Robert Michael William David Richard Thomas Peter Paul Daniel Andrew Hans Klaus Jürgen Wolfgang Stefan "
    "Pierre Jean Luc François Carlos José Juan Miguel Pedro Иван Александр Сергей Дмитрий Владимир Николай",
}
GENDER_OF = {n.casefold(): g for g, names in GIVEN.items() for n in names.split()}
TITLE_GENDER = {n.casefold(): g for g, names in TITLES.items() for n in names.split()}

_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)*"
PERSON = re.compile(
    rf"(?<!\w)(?:(?P<title>{'|'.join(n for names in TITLES.values() for n in names.split())})\.?[  ]+(?P<a>{_CAPITAL}(?:[  ]{_CAPITAL}){{0,2}})"
    rf"|(?P<b>(?:{'|'.join(n for names in GIVEN.values() for n in names.split())})(?:-{_CAPITAL})?(?:[  ]{_CAPITAL}){{1,2}}))(?!\w)"
)
FORMATS = re.compile(
    r"""(?P<email>(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,24}(?!\w))
    |(?P<secret>(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)(?:gh[pousr]|sk|pk|xox[abp])[_-][0-9A-Za-z_-]{16,}
      |(?<!\w)(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?[ ]*[=:][ ]*["']?(?P<value>[^\s"'<>,;]{6,}))
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?!\w))
    |(?P<mac>(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:]))
    |(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}(?::?[0-9A-Fa-f]{1,4})+(?![\w:]))
    |(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))
    |(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))
    """,
    re.X,
)
#: A text without any of these characters or prefixes can't hold an entity of FORMATS.
HINT = re.compile(r"[0-9@=:]")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp", "gho", "ghu", "ghs", "ghr", "sk-", "sk_", "pk-", "pk_", "xox")
#: First words of titles and given names. A text needs one among its words to hold a name: PERSON starts at a word and
#: ends each title and given name before a character outside \w, so the test never leaves out a match.
NAMES = frozenset(re.findall(r"\w+", n)[0] for names in (*TITLES.values(), *GIVEN.values()) for n in names.split())
WORDS = re.compile(r"\w+")
ALPHABETS = {
    "latin": ("bcdfghklmnprstvw", "aeiou"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
}


class Draw:
    """A stream of numbers from a keyed hash of an entity."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed = hashlib.blake2b(f"{kind}\0{value}\0{attempt}".encode(), key=key, digest_size=32).digest()
        self.bits, self.block = 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            self.block += 1
            self.bits = self.bits << 256 | int.from_bytes(hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest(), "big")
            self.left = (self.left or 1) << 256
        self.bits, out = divmod(self.bits, n)
        self.left //= n
        return out


def luhn_digit(digits: str) -> str:
    """Check digit that makes the digits plus itself valid."""
    total = sum(sum(divmod(int(c) * (1 + (k % 2 == 0)), 10)) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def pour(draw: Draw, text: str) -> str:
    """Each digit, hexadecimal or other letter becomes another of its kind; the rest stays."""
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            d = chr(97 + draw.below(6 if hexa else 26))
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def canonical(kind: str, text: str) -> str:
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", text)
        return digits[-10:] if kind == "phone" else digits
    if kind in ("iban", "mac", "ipv6"):
        return re.sub(r"[ :-]", "", text).lower() if kind == "mac" else text.replace(" ", "").lower()
    return text


def substitute(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """Canonical surrogate of a canonical entity."""
    draw = Draw(key, kind, value, attempt)
    longer = max(0, attempt - WIDER_FROM + 1)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        named = Draw(key, "domain", domain, 0)  # addresses of one domain stay together
        return f"{pour(draw, local)}{pour(draw, 'x0' * longer)}@{'.'.join(pour(named, x) for x in labels[:-1])}.{labels[-1]}"
    if kind == "ipv4":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + pour(draw, value[1:-1] + "0" * longer)
        right = luhn_digit(body)
        return body + (right if luhn_digit(value[:-1]) == value[-1] else str((int(right) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        return (str(2 + draw.below(8)) if len(value) == 10 else "") + pour(draw, value[len(value) == 10 :] + "0" * longer)
    if kind == "ssn":
        return f"{100 + draw.below(566):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + pour(draw, "0" * longer)
    if kind == "iban":
        body = pour(draw, value[4:] + "0" * longer).lower()
        number = "".join(str(int(c, 36)) for c in body + value[:2] + "00")
        return f"{value[:2]}{98 - int(number) % 97:02d}{body}"
    if kind in ("mac", "ipv6"):
        return "".join("0123456789abcdef"[draw.below(16)] if c.isalnum() else c for c in value)
    if kind == "secret":
        head = value[:4] if value[:4] in ("AKIA", "ASIA") else ""
        return head + pour(draw, value[len(head) :] + "x0" * longer)
    # names: syllables of the script; given names end as their gender often does
    consonants, vowels = ALPHABETS["cyrillic" if re.search("[а-яё]", value) else "latin"]
    size = 2 + draw.below(2) + attempt // 4
    out = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(size))
    if kind == "given-f":
        return out[:-1] + vowels[0]
    return out + consonants[draw.below(len(consonants))]


def refill(kind: str, found: str, surrogate: str) -> str:
    """The canonical surrogate in the format in which the entity was found."""
    if kind in ("email", "ipv4", "secret", "ipv6"):
        return surrogate.upper() if kind != "secret" and found.isupper() else surrogate
    if kind in ("card", "ssn", "phone", "iban", "mac"):
        keep = r"[0-9]" if kind in ("card", "ssn", "phone") else r"[0-9A-Za-z]"
        out, rest = list(found), list(surrogate)
        for k in range(len(out) - 1, -1, -1):
            if rest and re.match(keep, out[k]):
                c = rest.pop()
                out[k] = c.upper() if out[k].isupper() or kind == "iban" or (kind == "mac" and found.upper() == found) else c
        if rest:  # a surrogate longer than the entity
            out.insert(re.search(keep, found).start(), "".join(rest).upper() if kind == "iban" else "".join(rest))
        return "".join(out)
    return surrogate.upper() if found.isupper() else surrogate[:1].upper() + surrogate[1:]


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) in the order of the text, not overlapping."""
    found = []
    if HINT.search(text) or any(k in text for k in KEY_PREFIXES):
        for m in FORMATS.finditer(text):
            kind = next(k for k in FORMATS.groupindex if k != "value" and m[k])
            start, end = m.span("value") if kind == "secret" and m["value"] else m.span()
            found.append((start, end, kind, canonical(kind, text[start:end])))
    names: dict[str, str] = {}
    named = not NAMES.isdisjoint(WORDS.findall(text))
    for m in PERSON.finditer(text) if named else ():
        words = re.split(r"[  ]", m["a"] or m["b"])
        known = GENDER_OF.get(words[0].casefold(), GENDER_OF.get(words[0].partition("-")[0].casefold()))
        gender = TITLE_GENDER.get((m["title"] or "").casefold(), known)
        for k, w in enumerate(words):
            given = (k < len(words) - 1 and len(words) > 1) or (len(words) == 1 and known and not m["title"])
            names.setdefault(w, f"given-{known or gender or 'x'}" if given else "family")
    if names:
        spans = sorted(s[:2] for s in found)
        ends = list(accumulate((b for _, b in spans), max))
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)", text):
            # spans that start before the name ends; the last end among them says whether one meets it
            before = bisect_left(spans, (m.end(),))
            if not before or ends[before - 1] <= m.start():
                found.append((m.start(), m.end(), names[m[0]], m[0].casefold()))
    return sorted(found)


ENTITIES = pa.schema([("kind", pa.string()), ("value", pa.string())])


def later_attempts(docs: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, value, attempt) of the entities whose first draw collides, or None if there are none."""

    def entities(batch: pa.RecordBatch) -> list:
        found = sorted({(k, v) for t in batch.column(0).to_pylist() if t for _, _, k, v in find_entities(t)})
        return [[k for k, _ in found], [v for _, v in found]]

    @F.pandas_udf("string")
    def drawn(kinds: pd.Series, values: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([substitute(key, k, v, int(a)) for k, v, a in zip(kinds, values, attempts)], dtype=object)

    every = docs.select("text").mapInArrow(by_batch(ENTITIES, entities), "kind string, value string").distinct()
    state = materialize(every.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(MOST_ATTEMPTS):
        named = materialize(state.withColumn("surrogate", drawn("kind", "value", "attempt")), "surrogates")
        owner = named.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"))
        taken = named.join(owner, ["kind", "surrogate"]).where("value != owner").select("kind", "value")
        real = named.join(named.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi")
        again = materialize(taken.unionByName(real.select("kind", "value")).distinct().withColumn("more", F.lit(1)), "collisions")
        if again.isEmpty():
            break
        state = materialize(
            state.join(again, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")),
            "entities",
        )
    else:
        raise ValueError(f"a kind of entity has more values than surrogates after {MOST_ATTEMPTS} draws")
    late = state.where("attempt > 0")
    return None if late.isEmpty() else late


def replace_entities(docs: DataFrame, key: str | None = None, into: str = "_private") -> DataFrame:
    """`docs` with a struct column: text with surrogates and the entities (kind, start and end in the old text)."""
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"Give a key or set {KEY_SETTING}: whoever knows it can tell which surrogate stands for what")
    secret = hashlib.sha256(key.encode()).digest()
    late = later_attempts(docs, secret)

    def rewrite(text: str | None, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list]:
        if not text:
            return text, []
        out, at, found = [], 0, find_entities(text)
        for start, end, kind, value in found:
            if start < at:
                continue
            out += [text[at:start], refill(kind, text[start:end], substitute(secret, kind, value, attempts.get((kind, value), 0)))]
            at = end
        return "".join([*out, text[at:]]), [{"kind": k, "start": a, "end": b} for a, b, k, _ in found]

    kind = "text string, entities array<struct<kind:string,start:long,end:long>>"
    if late is None:

        @F.pandas_udf(kind)
        def plain(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, {}) for t in texts], columns=["text", "entities"])

        return docs.withColumn(into, plain(F.col("text")))

    def occurrences(batch: pa.RecordBatch) -> list:
        rows = [
            (i, k, v)
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if t
            for k, v in sorted({(k, v) for _, _, k, v in find_entities(t)})
        ]
        return [list(c) for c in zip(*rows)] if rows else [[], [], []]

    # Rare, but of any number: the attempts go to their texts by a digest of the text.
    tagged = docs.withColumn("_pii_text", F.sha2("text", 256))
    schema = pa.schema([("digest", pa.string()), ("kind", pa.string()), ("value", pa.string())])
    per_text = (
        tagged.select(F.col("_pii_text").alias("digest"), "text")
        .mapInArrow(by_batch(schema, occurrences), "digest string, kind string, value string")
        .join(late, ["kind", "value"])
        .distinct()
        .groupBy(F.col("digest").alias("_pii_digest"))
        .agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_pii_attempts"))
    )

    @F.pandas_udf(kind)
    def tried(texts: pd.Series, attempts: pd.Series) -> pd.DataFrame:
        rows = [
            rewrite(t, {(x["kind"], x["value"]): x["attempt"] for x in a} if a is not None else {}) for t, a in zip(texts, attempts)
        ]
        return pd.DataFrame(rows, columns=["text", "entities"])

    joined = tagged.join(materialize(per_text, "later-attempts"), F.col("_pii_text") == F.col("_pii_digest"), "left")
    return joined.withColumn(into, tried(F.col("text"), F.col("_pii_attempts"))).drop("_pii_text", "_pii_digest", "_pii_attempts")


def op2_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the tables of this query are synthetic; real ones need a key of their own
    return replace_entities(docs, spark.conf.get(KEY_SETTING, "synthetic-tables")).select(
        "doc_id", F.col("_private.text").alias("text"), F.size("_private.entities").cast("long").alias("n_entities")
    )
