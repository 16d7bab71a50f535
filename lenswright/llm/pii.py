"""Personal data: fixed base patterns, and bootstrapped contextual extraction.

Base kinds come from their patterns alone.  They and secret-looking keys are
the seeds of the bootstrap: the words around a seed induce lexical patterns, a
graph of patterns and instances is scored in Spark in a few rounds, and
patterns of high confidence mark further tokens, in shapes no base pattern
knows, as identifiers of their kind.  A candidate is any token with a digit or
an at sign, any run of digit groups with spaces among them, and any address
whose at sign is spelt out; so a pattern around ordinary numbers earns no
confidence.  An unknown candidate counts half against a pattern, as it may be
an identifier of an unseen shape; one that looks like an ordinary number (up to
six digits and no letter) and one of another kind count whole, and ordinary
numbers are never marked.

Defined cases: a null text is empty; repeated rows get equal results; a failed
base match is dropped without a retry within it; a run without white space is
also cut at marks (quotes, commas, ``;&?|``, braces, angles) and at letters of
scripts without spaces, and each part is a candidate, known by its key or its
neighbours in the run; contexts are whole words, and within a run reach over
two parts but not beyond the next seed in the same part; found spans never
overlap base spans.  No length is capped: instances are known by a hash of the
whole, long words of patterns by their beginning and a hash.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import columns, free_names, materialise, small_batches, tidy

KINDS = ("email", "ip", "card", "phone", "secret")
#: Distinct instances that a pattern must have seen, its least confidence, and rounds of scoring.
SUPPORT, CONFIDENCE, ROUNDS = 8, 0.8, 3
#: Instances of no kind that each pattern is held to have seen besides.
DOUBT = 2
#: What an unknown instance counts for; one like an ordinary number counts for one.
UNKNOWN = 0.5
#: Kinds of candidates that are no seeds: of unknown shape, and like ordinary numbers.
OTHER, PLAIN = -1, -2
#: Found spans of up to so many rows are sent to every task when texts are redacted.
BROADCAST_ROWS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only match from its start, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,})(?![0-9A-Za-z])")
_SPOT = re.compile(r"[0-9@]")
# Digit groups with spaces among them; groups are taken whole, so each run is read once.
_SPACED = re.compile(r"(?<![0-9A-Za-z])(?:\+|\+?\()?[0-9]++(?:(?: ?[-/()]{1,2} ?| \. |[. ])[0-9]++)+(?![0-9A-Za-z])")
# An at sign in brackets, or as a word before a name with a spelt-out dot; what follows it.
_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s(?=[A-Za-z0-9-]++\sdot\s)", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]++(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\.)[A-Za-z0-9-]++)+", re.I)
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`()[]{}<>,.;:!?*#$%&|"
#: Letters and marks of scripts that don't space words, and what cuts a run.
_DENSE = "\u0e00-\u0e7f\u3000-\u30ff\u3400-\u9fff\uff00-\uffef"
_MARK = re.compile(rf"[\"',;&?|{{}}<>{_DENSE}]")
_PART = re.compile(rf"[^\s\"',;&?|{{}}<>{_DENSE}]+")
_BEFORE = re.compile(rf"[{_DENSE}]{{1,4}}\Z")
_AFTER = re.compile(rf"[{_DENSE}]{{1,4}}")
_KEY_END = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*)[\"']?([=:]+[\"']?)\Z")
_KEYED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*[=:]+[\"']?(?=.)")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    twice = "0246813579"
    return sum(int(twice[int(d)] if k % 2 else d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start; code points, end exclusive."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _hash(text: str) -> int:
    """A signed 64-bit hash of a whole text."""
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) ^ 1 << 63) - (1 << 63)


def _norm(word: str) -> str:
    word = _DIGIT.sub("0", word.lower())
    return word if len(word) <= 40 else f"{word[:40]}~{_hash(word):x}"


class Contexts:
    """The words of a text, the parts of its runs, and the lexical patterns of spans among them; seeds are sorted spans."""

    def __init__(self, text: str, seeds: list[tuple[int, int]]):
        self.text, self.seeds = text, seeds
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.parts: dict[int, list[tuple[int, int]]] = {}
        self.normed: dict[int, str] = {}

    def word_at(self, at: int) -> int:
        return bisect.bisect_right(self.words, (at, len(self.text))) - 1

    def parts_of(self, word: int) -> list[tuple[int, int]]:
        if word not in self.parts:
            self.parts[word] = [m.span() for m in _PART.finditer(self.text, *self.words[word])]
        return self.parts[word]

    def norm(self, word: int) -> str:
        """A word as patterns have it; nothing beyond the text's ends."""
        if not 0 <= word < len(self.words):
            return ""
        if word not in self.normed:
            s, e = self.words[word]
            self.normed[word] = _norm(self.text[s:e])
        return self.normed[word]

    def around(self, start: int, end: int) -> tuple[int, int, str, str]:
        """The words of a span's ends, and what stands before and after it in them."""
        i, j = self.word_at(start), self.word_at(end - 1)
        ws, we = self.words[i][0], self.words[j][1]
        before, after = self.parts_of(i), self.parts_of(j)
        k = bisect.bisect_right(before, (start, len(self.text))) - 1
        own = before[k][0] if k >= 0 and before[k][1] > start else start
        lo = before[k - 2][0] if k >= 2 else ws
        m = bisect.bisect_right(after, (end - 1, len(self.text))) - 1
        last = after[m][1] if m >= 0 and after[m][1] >= end else end
        hi = after[m + 2][1] if m + 2 < len(after) else we
        near = bisect.bisect_left(self.seeds, (start, -1))
        if near and own < self.seeds[near - 1][1] <= start:
            lo = self.seeds[near - 1][1]
        near = bisect.bisect_left(self.seeds, (end, -1))
        if near < len(self.seeds) and self.seeds[near][0] < last:
            hi = self.seeds[near][0]
        return i, j, self.text[lo:start], self.text[end:hi]

    def patterns(self, start: int, end: int) -> list[str]:
        """A span's key, the words before, after and on either side."""
        i, j, before, after = self.around(start, end)
        left = [self.norm(i - 1), _norm(before)] if before else [self.norm(i - 2), self.norm(i - 1)]
        right = [_norm(after), self.norm(j + 1)] if after else [self.norm(j + 1), self.norm(j + 2)]
        out = []
        if before and before.rstrip("\"'")[-1:] in ("=", ":"):
            out.append(f"key {left[1]}")
        elif left[1][-1:] in ("=", ":"):
            out.append(f"cue {left[1]}")
        if left[0]:
            out.append(f"two {left[0]} {left[1]}")
        if left[1]:
            out += [f"pre {left[1]}", f"mid {left[1]} _ {right[0]}"]
        if right[1]:
            out.append(f"aft {right[0]} {right[1]}")
        return out

    def patterns_within(self, start: int, end: int) -> list[str]:
        """The patterns of a span inside a run that marks cut: its key and the parts on either side; none elsewhere."""
        _, _, before, after = self.around(start, end)
        parts, more = ([p for p in _PART.findall(x) if any(map(str.isalnum, p))] for x in (before, after))
        dense, follows = _BEFORE.search(before[-4:]), _AFTER.match(after)
        if not ((parts or dense) and _MARK.search(before) or (more or follows) and _MARK.search(after)):
            return []
        out = []
        if key := _KEY_END.search(before):
            out.append(f"key {_norm(key[1] + key[2])}")
        if dense:
            out.append(f"cue {dense[0]}")
        if dense or parts:
            out.append(f"cut {dense[0] if dense else _norm(parts[-1])} _ {follows[0] if follows else _norm((more or [''])[0])}")
        return out


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    """A token or part without its key and edges."""
    token = text[start:end]
    keyed = _KEYED.match(token)
    return start + (keyed.end() if keyed else len(token) - len(token.lstrip(_EDGE))), end - (len(token) - len(token.rstrip(_EDGE)))


def loose_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifiers that may reach over several words: spelt-out addresses and spaced digits, apart from ``taken``; sorted, disjoint."""
    out, floor = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        name = _SPELT.match(text, m.end()) if start < m.start() and m.start() >= floor else None
        floor = max(floor, name.end() if name else m.end())
        if name and not _hits(taken, start, floor):
            out.append((start, floor))
    mails = list(out)
    out += [m.span() for m in _SPACED.finditer(text) if " " in m[0] and not _hits(taken, *m.span()) and not _hits(mails, *m.span())]
    return sorted(out)


def _unknown(token: str) -> int:
    """The kind of a candidate that is no seed."""
    return OTHER if len(_digits(token)) > 6 or " . " in token or any(c.isalpha() or c == "@" for c in token) else PLAIN


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[str]]]:
    """Seeds and unknown tokens as (kind, ``OTHER`` or ``PLAIN``; start, end, instance, patterns)."""
    seeds = list(base)
    taken = _merged(sorted((s, e) for _, s, e in seeds))
    for m in _SECRET.finditer(text):
        if not _hits(taken, m.start(), m.end()):
            seeds.append((4, m.start(), m.end()))
    taken = _merged(sorted((s, e) for _, s, e in seeds))
    spot, loose = _SPOT.search(text), loose_spans(text, taken)
    if not seeds and not spot and not loose:
        return []
    near = Contexts(text, taken)
    out = [(k, s, e, _hash(text[s:e].lower()), list(dict.fromkeys(near.patterns(s, e) + near.patterns_within(s, e)))) for k, s, e in seeds]
    out += [(_unknown(text[s:e]), s, e, _hash(text[s:e].lower()), near.patterns(s, e)) for s, e in loose]
    while spot:
        word = near.word_at(spot.start())
        start, at = near.words[word]
        whole = s, e = _stripped(text, start, at)
        if s < e and not _hits(taken, s, e) and not _hits(loose, s, e) and _SPOT.search(text, s, e):
            out.append((_unknown(text[s:e]), s, e, _hash(text[s:e].lower()), near.patterns(s, e)))
        for part in near.parts_of(word) if _MARK.search(text, start, at) else ():
            s, e = _stripped(text, *part)
            if s < e and (s, e) != whole and _SPOT.search(text, s, e) and not _hits(taken, s, e) and not _hits(loose, s, e) and (found := near.patterns_within(s, e)):
                out.append((_unknown(text[s:e]), s, e, _hash(text[s:e].lower()), found))
        spot = _SPOT.search(text, at)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _hits(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether [s, e) overlaps one of the sorted spans."""
    k = bisect.bisect_left(spans, (e, -1))
    return any(b > s for _, b in spans[max(0, k - 2) : k])


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_SPAN = StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
_CANDIDATE = StructType([*_SPAN.fields, StructField("instance", LongType()), StructField("patterns", ArrayType(StringType()))])
_SPAN_ARROW = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_CANDIDATE_ARROW = pa.struct([*_SPAN_ARROW, ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])


def _name(docs: DataFrame, k1: str = "k1", k2: str = "k2") -> tuple[Column, Column]:
    """Names a row by two hashes of its id and text; repeated rows share them."""
    return F.xxhash64(docs["doc_id"], docs["text"]).alias(k1), F.xxhash64(docs["text"], F.lit(1), docs["doc_id"]).alias(k2)


def _as_spans(spans: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=False)) for s in row] for row in spans], pa.list_(_SPAN_ARROW))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: the row's name k1 and k2, doc_id, base spans, and the candidates with their patterns."""
    small_batches(docs.sparkSession)
    schema = StructType([StructField("k1", LongType()), StructField("k2", LongType()), docs.schema["doc_id"], StructField("base", ArrayType(_SPAN)), StructField("found", ArrayType(_CANDIDATE))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "instance", "patterns")
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            base = [base_spans(t) for t in texts]
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t, s)] for t, s in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _as_spans(base), pa.array(found, pa.list_(_CANDIDATE_ARROW))], names=["k1", "k2", "doc_id", "base", "found"])

    return docs.select(*_name(docs), "doc_id", "text").mapInArrow(tidy(work), schema)


def learn(scanned: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Score the graph of patterns and instances: (pattern, kind, confidence) of the trusted patterns.

    An edge counts once however often it occurs.  A seed is surely of its kind;
    one of unknown shape is of a kind as far as its best trusted pattern says;
    a pattern's confidence in a kind is the mean of its instances' belief, where
    an unknown one weighs ``UNKNOWN`` unless it is like an ordinary number, with
    ``DOUBT`` instances of no kind besides.  Scores only rise from round to round.
    """
    edges = (
        scanned.select(F.explode("found").alias("c")).select("c.kind", "c.instance", F.explode("c.patterns").alias("pattern"))
        .groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    )
    edges = materialise(edges, "pii-edges")
    weight = F.when(F.col("kind") == OTHER, F.lit(UNKNOWN)).otherwise(F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("seeds"))
    trusted = None
    unknown = edges.where(F.col("kind") == OTHER).select("pattern", "instance")
    for _ in range(rounds):
        belief = seeds
        if trusted is not None:
            named = unknown.join(trusted, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
            more = unknown.join(named, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("belief") * UNKNOWN).alias("seeds"))
            belief = seeds.unionByName(more).groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"))
        scored = belief.join(sizes, "pattern").withColumn("confidence", F.col("seeds") / (F.col("weight") + DOUBT))
        trusted = materialise(scored.where((F.col("n") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"), "pii-patterns")
    return trusted


def discover(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """(k1, k2, more): spans that trusted patterns mark, and seeds of kinds that have no base pattern."""
    flat = scanned.select("k1", "k2", F.explode("found").alias("c")).select("k1", "k2", "c.kind", "c.start", "c.end", "c.patterns")
    seeds = flat.where("kind >= 4").select("k1", "k2", F.struct("kind", "start", "end").alias("span"))
    marked = (
        flat.where(F.col("kind") == OTHER).select("k1", "k2", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern")
        .groupBy("k1", "k2", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        .select("k1", "k2", F.struct("kind", "start", "end").alias("span"))
    )
    return seeds.unionByName(marked).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("span")).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans of every row of ``docs``, each as an array of (kind, start, end)."""
    scanned = materialise(scan(docs), "pii-scan")
    more = discover(scanned, learn(scanned))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", F.coalesce("more", F.array()))))
    return scanned.select("k1", "k2", "doc_id", "base").join(more, ["k1", "k2"], "left").select("doc_id", "base", every.alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """The counts of base kinds, the digest of base spans, all spans as text, and their number."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return find(docs).select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, and n_chars, if there, brought in line."""
    scanned = materialise(scan(docs), "pii-scan")
    more = materialise(discover(scanned, learn(scanned)), "pii-found")
    if more.count() <= BROADCAST_ROWS:
        more = F.broadcast(more)
    small_batches(docs.sparkSession)
    lower = [c.lower() for c in docs.columns]
    text_at, names, schema = lower.index("text"), list(docs.columns), docs.schema
    k1, k2, extra = free_names(docs, "k1", "k2", "more")

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                spans = sorted((s, e, k) for k, s, e in [*base_spans(text or ""), *((x["kind"], x["start"], x["end"]) for x in found or [])])
                parts, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append(text if not spans else "".join(parts) + text[at:])
            changed = [pa.array(out, pa.string()) if k == text_at else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(changed, names=names)

    named = docs.select(*columns(docs), *_name(docs, k1, k2)).join(more.withColumnsRenamed({"k1": k1, "k2": k2, "more": extra}), [k1, k2], "left")
    done = named.select(*columns(docs), extra).mapInArrow(tidy(replaced), schema)
    if "n_chars" in lower:
        at = names[lower.index("n_chars")]
        done = done.withColumn(at, F.length("text").cast(schema[at].dataType))
    return done
