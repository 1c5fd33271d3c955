"""Personal data and secrets replaced by keyed surrogates of the same type, script and format.

A detected entity's surrogate depends on the key, its type and its canonical form alone, so each mention of it in any document gets
the same one (coreference). Numbers and codes are replaced by a keyed permutation of all strings of their format, so different
entities cannot get one surrogate; names are drawn from keyed lists of their script, longer ones with each attempt, and a
collision check over the distinct entities of the corpus draws again where two meet. A person is a name without its title; names
are found after titles, and then in the whole document. Postal addresses are not found.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_arrow_batches, text_or_empty

#: The key of production runs comes from a secret store; this one is for tests and queries over invented data.
KEY = b"voxlake-example-key"

#: Patterns of entities, the first that matches at a place wins.
PATTERNS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("assigned_secret", r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b\s*[=:]\s*\"?)(?P<assigned_secret_body>[A-Za-z0-9+/_-]{8,})"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d.]\d|\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    # International numbers in any groups, of their country's length where it is one of the listed ones, national ones with a trunk zero, and three groups.
    ("phone", r"(?<![\w.])(?:\+(?:[17](?:[ ./()-]{0,2}\d){10}|3[34](?:[ ./()-]{0,2}\d){9}|4[14](?:[ ./()-]{0,2}\d){9,10}|[1-9](?:[ ./()-]{0,2}\d){7,14})(?!\d|\.\d)|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\d-])|\(?0\d(?:[ .-]\d{2}){4}(?![\d-])|(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{5,9}(?![\d-]))"),
    ("person", r"\b(?P<person_title>Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Sr|Sra|Dr|г-н|г-жа)\.? (?P<person_body>(?:[ODL]['’])?[^\W\d_]+(?:[ -](?:[ODL]['’])?[A-ZÀ-ÖØ-ÞЀ-Я][^\W\d_]+){0,3})"),
)

#: Given names by script, each borne by women and men, so that they fit any title; and parts of family names.
GIVEN = {
    "latin": ("Alex", "Andrea", "Chris", "Dominique", "Eli", "Jessie", "Jo", "Jules", "Kim", "Luca", "Maxime", "Nicola", "Noa", "Robin", "Sam", "Sascha"),
    "cyrillic": ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Вася", "Мика"),
}
FAMILY = {
    "latin": ("al", "ber", "cor", "dan", "el", "fal", "gor", "hal", "in", "kar", "lin", "mor", "nel", "or", "pel", "ros", "sal", "ten", "ul", "ver", "wen", "zan"),
    "cyrillic": ("бел", "вор", "гор", "дан", "зим", "кар", "лин", "мор", "нел", "пет", "рос", "сол", "тан", "ур", "чер", "шан"),
}

_ALL = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))
_NO_CARD = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS if name != "card"))
#: Digits in one run, or in the groups of printed cards.
_CARD_GROUPS = re.compile(r"\d+|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{4,5}")
#: Something that every match holds: texts without any are passed over.
_HINT = re.compile(r"[\d@=:]|-----BEGIN|\b(?:M(?:rs?|s|iss|onsieur|adame)|Herr|Frau|Señora?|Sra?|Dr|г-)\b")

_HEX = "0123456789abcdef"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(code: str) -> int:
    """Digits as they are, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code)) % 97


def _card_within(value: str) -> tuple[int, int] | None:
    """The longest run of some of the value's groups of digits that has a card's length and check sum."""
    groups = [g.span() for g in re.finditer(r"\d+", value)]
    runs = [(groups[i][0], groups[j][1]) for i in range(len(groups)) for j in range(i, len(groups)) if j - i < len(groups) - 1]
    fits = [(a, b) for a, b in runs if 13 <= len(digits := re.sub(r"\D", "", value[a:b])) <= 19 and _luhn(digits)]
    return max(fits, key=lambda r: r[1] - r[0], default=None)


def _with_untitled(text: str, found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """The entities, and all other mentions of their persons: the whole name, and of longer names the last word."""
    names = {text[start:end] for start, end, kind, _, _ in found if kind == "person" and text[start].isupper()}
    names |= {last for name in names if len(last := re.split("[ -]", name)[-1]) > 2}
    if not names:
        return found
    words = sorted({n for name in names for n in (name, name.upper())}, key=lambda n: (-len(n), n))
    taken, i, out = found, 0, list(found)
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(r"\s+".join(map(re.escape, n.split())) for n in words) + r")(?!\w)", text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or m.end() <= taken[i][0]:
            out.append((m.start(), m.end(), "person", " ".join(m.group().lower().split()), ""))
    return sorted(out)


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """Entities of a text as (start, end, type, canonical form, attributes), in order and apart."""
    if not _HINT.search(text):
        return []
    out, at, m = [], 0, None
    while m := _ALL.search(text, at):
        start, end = m.span()
        if m.group("card") is not None and not _luhn(re.sub(r"\D", "", m.group())):
            if part := _card_within(m.group()):
                start, end = m.start() + part[0], m.start() + part[1]
                out.append((start, end, "card", re.sub(r"\D", "", text[start:end]), ""))
                at = end
                continue
            # A number of a card's format stays as it is; groups of other lengths may be a phone number and more.
            m = None if _CARD_GROUPS.fullmatch(m.group()) else _NO_CARD.search(text, start)
            if m is None or m.start() >= end:
                at = end
                continue
        kind = next(name for name, _ in PATTERNS if name in m.re.groupindex and m.group(name) is not None)
        body = f"{kind}_body" if kind in ("assigned_secret", "person") else kind
        start, end, value = m.start(body), m.end(body), m.group(body)
        at = m.end()
        if kind in ("card", "phone", "ssn", "iban"):
            value = re.sub(r"[^0-9A-Z+]", "", value)
        elif kind == "email":
            value = value.lower()
        elif kind == "person":
            value = " ".join(value.lower().split())
        out.append((start, end, kind, value, ""))
    return _with_untitled(text, out)


def _stream(key: bytes, label: str) -> Iterator[int]:
    block, i = b"", 0
    while True:
        block = hmac.new(key, f"{label}\0{i}".encode(), hashlib.sha256).digest()
        yield from block
        i += 1


def _permuted(key: bytes, label: str, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of all mixed-radix numbers of these sizes: each round shifts one half by a keyed function of the other."""
    half = (len(values) + 1) // 2
    a, b = values[:half], values[half:]
    sa, sb = sizes[:half], sizes[half:]
    if not b:
        s = _stream(key, f"{label}\0one")
        return [(v + (next(s) << 8 | next(s))) % n for v, n in zip(a, sa, strict=True)]
    for r in range(8):
        source, target, radix = (b, a, sa) if r % 2 == 0 else (a, b, sb)
        s = _stream(key, f"{label}\0{r}\0{source}")
        shifted = [(v + (next(s) << 16 | next(s) << 8 | next(s))) % n for v, n in zip(target, radix, strict=True)]
        a, b = (shifted, b) if r % 2 == 0 else (a, shifted)
    return a + b


def _same_format(key: bytes, label: str, value: str, fixed: int = 0) -> str:
    """Digits for digits, letters for letters of the same case, hexadecimal for hexadecimal; other characters and the first ``fixed`` ones stay."""
    kinds = (_HEX,) if re.fullmatch("[0-9a-f]{16,}", value) else (_DIGITS, _LOWER, _UPPER)
    classes = [next((c for c in kinds if ch in c), None) if i >= fixed else None for i, ch in enumerate(value)]
    places = [i for i, c in enumerate(classes) if c]
    # The shape is part of the label: values of one shape are permuted among themselves, so different ones stay different.
    shape = "".join("x" if c is _HEX else "d" if c is _DIGITS else "l" if c is _LOWER else "u" if c is _UPPER else ch for c, ch in zip(classes, value, strict=True))
    new = _permuted(key, f"{label}\0{shape}", [classes[i].index(value[i]) for i in places], [len(classes[i]) for i in places])
    out = list(value)
    for i, v in zip(places, new, strict=True):
        out[i] = classes[i][v]
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attributes: str = "", attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity; another one for each attempt."""
    label = f"{kind}\0{attempt}"
    if kind == "email":
        user, _, host = value.partition("@")
        s = _stream(key, f"{label}\0{value}\0more")
        more = "".join(_LOWER[next(s) % 26] for _ in range(attempt))
        return f"{_same_format(key, label, user)}@{_same_format(key, f'{label}\0host', host.split('.')[0])}{more}.example"
    if kind == "ip":
        octets = _permuted(key, label, [int(x) for x in value.split(".")], [256] * 4)
        return ".".join(map(str, octets))
    if kind == "card":
        # All digits but the last are permuted; the last makes the check sum right again.
        body = _same_format(key, label, value[:-1])
        return next(body + d for d in _DIGITS if _luhn(body + d))
    if kind == "iban":
        # The country stays, the account is permuted, and the two digits between make the check sum right again.
        account = _same_format(key, label, value[4:])
        return f"{value[:2]}{98 - _mod97(account + value[:2] + '00'):02d}{account}"
    if kind == "person":
        s = _stream(key, f"{label}\0{value}")
        script = "cyrillic" if re.search("[А-я]", value) else "latin"
        given, parts = GIVEN[script], FAMILY[script]
        # Each attempt draws from names that are longer by a part: there are always enough.
        family = "".join(parts[next(s) % len(parts)] for _ in range(4 + attempt)).capitalize()
        return f"{given[next(s) % len(given)]} {family}" if " " in value or "-" in value else family
    if kind == "private_key":
        head, tail = re.match(r"-----[^-]*-----", value), re.search(r"-----END[^-]*-----$", value)
        return head[0] + _same_format(key, label, value[head.end() : tail.start()]) + tail[0]
    return _same_format(key, label, value, {"aws_key": 4, "github_token": 4}.get(kind, 2 if kind == "phone" and value.startswith("+") else 0))


def _shaped(kind: str, canonical: str, mention: str) -> str:
    """The canonical surrogate in the format of a mention: its separators, and the case of names."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(canonical)
        return "".join(next(signs, "") if c.isalnum() or c == "+" else c for c in mention)
    if kind == "person" and mention.isupper():
        return canonical.upper()
    if kind == "email" and mention.isupper():
        return canonical.upper()
    return canonical


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(kind, value, attributes) for text in batch["text"].to_pylist() for _, _, kind, value, attributes in detect(text)}
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in seen], pa.string()) for i in range(3)], ["kind", "value", "attributes"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [surrogate(key, k, v, a, n) for k, v, a, n in zip(*(batch[c].to_pylist() for c in ("kind", "value", "attributes", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "name"])

    return run


def collisions(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attributes, attempt) of distinct entities whose first surrogate another entity of their type has, or is an entity itself.

    The smallest entity keeps a surrogate, the others draw again until all differ. The table is the exception list: with
    permuted formats it holds names alone, and few of these.
    """
    pending = checkpointed(entities.groupBy("kind", "value", "attributes").count().drop("count").withColumn("attempt", F.lit(0)))
    taken = checkpointed(pending.select("kind", F.col("value").alias("name")))
    result = None
    schema = "kind string, value string, attributes string, attempt int, name string"
    while True:
        named = checkpointed(pending.mapInArrow(_drawn(key), schema))
        # Names are compared as entities are held, in lower case.
        named = named.withColumn("name", F.when(F.col("kind").isin("person", "email"), F.lower("name")).otherwise(F.col("name")))
        rank = F.row_number().over(Window.partitionBy("kind", "name").orderBy("value", "attributes"))
        ranked = named.withColumn("rank", rank).join(taken.withColumn("used", F.lit(True)), ["kind", "name"], "left")
        ranked = checkpointed(ranked.withColumn("lost", (F.col("rank") > 1) | F.coalesce("used", F.lit(False))))
        settled = ranked.where("not lost and attempt > 0").select("kind", "value", "attributes", "attempt")
        result = settled if result is None else result.unionByName(settled)
        lost = ranked.where("lost")
        if not lost.limit(1).count():
            return checkpointed(result)
        taken = checkpointed(taken.unionByName(ranked.where("not lost").select("kind", "name")))
        pending = checkpointed(lost.select("kind", "value", "attributes", (F.col("attempt") + 1).alias("attempt")))


def replace(text: str, key: bytes, attempts: dict[tuple[str, str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' places in the original."""
    parts, at, spans = [], 0, []
    for start, end, kind, value, attributes in detect(text):
        parts += (text[at:start], _shaped(kind, surrogate(key, kind, value, attributes, attempts.get((kind, value, attributes), 0)), text[start:end]))
        spans.append((start, end, kind))
        at = end
    return "".join([*parts, text[at:]]), spans


def _replaced(key: bytes, kinds: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        for batch in batches:
            texts, spans = [], []
            for text, odd in zip(batch["text"].to_pylist(), batch["odd"].to_pylist(), strict=True):
                new, found = replace(text, key, {(o["kind"], o["value"], o["attributes"]): o["attempt"] for o in odd or ()})
                texts.append(new)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], ["doc_id", "text", "entities"])

    return run


def pii_surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per document: ``doc_id, text, entities`` (array of start, end, kind in characters of the original).

    Digits that fail a card's check sum are no card and stay. Texts without personal data come back as they are; null counts as empty. Repeated rows are treated alike; ids may be null; other columns are not read; an empty
    table gives an empty result. Whole texts are read. Texts are not shuffled, except those that mention an entity from the
    exception list, where it is too long to be broadcast.
    """
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    entities = rows.select("text").mapInArrow(_detected, "kind string, value string, attributes string").distinct()
    odd = collisions(entities, key)
    kinds = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kinds}, text string, entities array<struct<start:int,end:int,kind:string>>"
    none = F.lit(None).cast("array<struct<kind:string,value:string,attributes:string,attempt:int>>")
    if not odd.limit(1).count():
        return rows.withColumn("odd", none).mapInArrow(_replaced(key, kinds), out)
    named = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    mentions = named.mapInArrow(_mentions, "row bigint, kind string, value string, attributes string").join(odd, ["kind", "value", "attributes"])
    lists = mentions.groupBy("row").agg(F.collect_set(F.struct("kind", "value", "attributes", "attempt")).alias("odd"))
    return named.join(lists, "row", "left").select("doc_id", "text", "odd").mapInArrow(_replaced(key, kinds), out)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {(row, kind, value, attributes) for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True) for _, _, kind, value, attributes in detect(text)}
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.string()) for i in (1, 2, 3))], ["row", "kind", "value", "attributes"])
