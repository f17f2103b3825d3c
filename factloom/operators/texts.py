"""Text operators: sentences, chunks, scalar values, keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MIN_SENTENCES, MAX_SENTENCES, MAX_CHUNKS = 1200, 2, 6, 200

#: What each kind of scalar looks like, and what a text must contain to hold one.
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
SCALARS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "cidr": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2}\b",
    "ipv4": rf"\b(?:{OCTET}\.){{3}}{OCTET}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "ipv6_short": r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b",
    "url": r"https?://[^\s]+",
    "mac": r"\b[0-9a-fA-F]{2}(?:(?::[0-9a-fA-F]{2}){5}|(?:-[0-9a-fA-F]{2}){5})\b",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}\b",
    "port": r"\bport +[1-9][0-9]{0,4}\b",
    "fqdn": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){2,}[a-zA-Z]{2,}\b",
    "date": r"\b[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
}
MARKS = {"email": "@", "cidr": "/", "ipv4": ".", "ipv6": ":", "ipv6_short": "::", "url": "://", "phone": "+", "port": "port ", "fqdn": ".", "date": "-", "uuid": "-"}


def sentences(text: Column) -> Column:
    """Sentences: text cut at white space after a full stop, question or exclamation mark."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the place as what to trim


def scalars(docs: DataFrame, kinds: dict[str, str] = SCALARS) -> DataFrame:
    """(doc_id, kind, value, n): every scalar value of every text."""
    none = F.expr("cast(array() as array<string>)")

    def one(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind in MARKS:  # no pattern runs over a text that cannot match
            values = F.when(F.contains(F.col("text"), F.lit(MARKS[kind])), values).otherwise(none)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.flatten(F.array(*[one(kind, pattern) for kind, pattern in kinds.items()]))
    return docs.select("doc_id", F.inline(found)).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


def ordered_distinct(items: Column) -> Column:
    """The items without repeats, first places kept; case is ignored."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def invented(text: Column, source: Column) -> Column:
    """Words of the text that its source does not have."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    return F.array_sort(F.array_except(words(text), words(source)))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def fingerprint(*parts: Column) -> Column:
    """sha256 over fields, divided by a character that none has."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


#: Modifiers that only point, and the article that leads.
ARTICLES = ["the", "a", "an", "my", "your", "our", "their", "this", "that"]


def synonym_key(term: Column) -> Column:
    """A key for terms that mean the same: lowered, one separator, no possessive, no leading article."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(term), r"[-_]+", " "), r"'s\b", ""))
    flat = F.regexp_replace(flat, r"[^a-z0-9 ]", "")
    parts = F.filter(F.split(flat, r"\s+"), lambda w: w != "")
    headless = F.when((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(ARTICLES), F.slice(parts, F.lit(2), F.size(parts) - 1)).otherwise(parts)
    return F.array_join(headless, " ")


def relation_name(phrase: Column) -> Column:
    """A relation phrase in snake case, without leading determiners and auxiliaries."""
    flat = F.regexp_replace(F.lower(phrase), r"[^a-z0-9]+", " ")
    flat = F.regexp_replace(F.trim(flat), r"^(?:(?:the|a|an|my|your|his|her|its|our|their|is|are|was|were|be|been|has|have|had|do|does|did|will|would|can|could) )+", "")
    return F.regexp_replace(F.trim(flat), r"\s+", "_")


def unmatched(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentences (doc_id, position, sentence) of four words or more without any of their document's terms (doc_id, term)."""
    held = terms.groupBy("doc_id").agg(F.collect_set(F.lower("term")).alias("terms"))
    joined = parts.join(held, "doc_id", "left")
    named = F.exists("terms", lambda t: F.contains(F.lower(F.col("sentence")), t))
    return joined.where(~F.coalesce(named, F.lit(False)) & (F.size(F.split(F.trim("sentence"), r"\s+")) >= 4)).select("doc_id", "position", "sentence")


def _gathered(items: Column, weight, joiner: str, fits) -> Column:
    """Neighbouring items joined while fits(open text, its weight, item, its weight)."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        more = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(joiner), s).alias("open"), (acc["n"] + weight(s)).alias("n"))
        done = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.when((acc["n"] > 0) & fits(acc["open"], acc["n"], s, weight(s)), more).otherwise(F.struct(done.alias("done"), s.alias("open"), weight(s).alias("n")))

    end = lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(items, start, step, end)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, position, chunk, truncated): texts cut into chunks for extraction.

    Paragraphs end at blank lines.  One over 1,200 characters is cut at sentence
    ends into pieces of at most 1,200 characters and six sentences; a longer
    sentence stays whole.  A piece takes the next one in, over a blank line,
    while it has fewer than two sentences and both stay within six sentences and
    1,200 characters.  Every chunk is returned; ``truncated`` marks those past
    the 200 at which the surveyed system stops.
    """
    room = lambda o, s, gap: F.length(o) + F.length(s) + 2 * gap <= MAX_CHARS
    paragraphs = F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", ""))
    cut = lambda p: _gathered(sentences(p), lambda s: F.lit(1), " ", lambda o, n, s, m: (n < MAX_SENTENCES) & room(o, s, 1))
    pieces = F.flatten(F.transform(F.filter(paragraphs, lambda p: p != ""), lambda p: F.when(F.length(p) <= MAX_CHARS, F.array(p)).otherwise(cut(p))))
    held = lambda p: F.greatest(F.lit(1), F.size(sentences(p)))
    merged = _gathered(F.col("pieces"), held, "\n\n", lambda o, n, p, m: (n < MIN_SENTENCES) & (n + m <= MAX_SENTENCES) & room(o, p, 2))
    rows = docs.select("doc_id", pieces.alias("pieces")).select("doc_id", F.posexplode(merged).alias("position", "chunk"))
    return rows.select("doc_id", (F.col("position") >= MAX_CHUNKS).alias("truncated"), "position", "chunk")
