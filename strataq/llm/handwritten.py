"""Files nobody wrote by hand for their module: tool output, minified code, third-party copies, data as code.

Header notices label a bounded training sample; the headers are then hidden, and
a random forest learns from compression ratio, token entropy, identifier lengths,
comment density, line shape, the share of literals and of dense long lines, and
whether the file's five-word shingles lie in third-party code. The forest decides
first; what it leaves, exact checks settle: a notice, a place, literals and next
to nothing else, dense long lines throughout, shingles of third-party code.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.common import spread, stash

#: Labelled files of each class the forest is fitted on at most, the least by a hash of their id.
TRAINING_FILES = 3000
#: Without this many files of each class there is no forest; notices and exact rules still hold.
LEAST_TRAINING = 10
TREES, DEPTH, SEED = 60, 8, 11
TOOL_PROBABILITY = 0.6
#: Share of a file's five-word shingles in third-party code from which it is a copy.
COPY_SHARE = 0.8
WORDS = 5
#: Share of a file's signs that lie in literals from which it is data; share of code on very long lines from which it is minified.
DATA_SHARE, LONG_LINE, MINIFIED_SHARE = 0.93, 200, 0.5
#: log2 of the bits that stand for third-party shingles while candidates are sought; more shingles than about a
#: tenth of the bits only let more candidates through to the exact count.
FILTER_BITS = 25

FEATURES = ["ratio", "entropy", "ident_mean", "ident_short", "ident_long", "ident_distinct", "comment_share", "line_mean", "line_max", "literal_share", "digit_share", "blank_share", "repeat_share", "dense_share"]

_PREAMBLE = re.compile(r"\A(?:\s+|//[^\n]*|/\*.*?\*/|<!--.*?-->|#![^\n]*|#[^\n]*)*", re.S)
_COMMENTS = re.compile(r"/\*.*?\*/|^[ \t]*//[^\n]*$", re.S | re.M)
_LITERALS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'|\b0x[0-9a-fA-F]+\b|\b\d+(?:\.\d+)?\b")
_TOKENS = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'|[^\w\s]")
_SIGNS = frozenset(",[]{}():;-+=")
_PACKAGE = re.compile(r"^package \w+[ \t]*;?[ \t]*$", re.M)

#: How notices of tools, of keepers and of third parties read.
_TOOL = re.compile(
    r"^(?:@?(?:auto-?)?generated\b(?! (?:by|from) hand)|code generated\b.*do not edit|code generated (?:by|from)\b|<auto-?generated|auto-?generated\b|(?:this (?:file|code|class|module) (?:was|is|has been) )?(?:automatically|machine)[- ]generated\b|"
    r"generated (?:code|file|by|from|with|using|automatically)\b|this (?:file|code) (?:was|is|has been) (?:auto-?)?generated\b|do not (?:edit|modify)\b.*\b(?:written|generated|produced|created|overwritten)\b|"
    r"(?:written|produced|created|emitted) (?:automatically )?by .*do not (?:edit|modify)|warning:? .*generated\b)",
    re.I,
)
_KEPT = re.compile(r"\b(?:kept|maintained|edited|written|rewritten) by hand\b|edit freely|\b(?:is|are) ours\b|please do edit|no longer generated|not generated|hand-?written|hand-?edited|(?:safe|fine|free) to edit", re.I)
_HOLDER = re.compile(r"(?:copyright|\(c\)|©)[\s:]*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-–,]\s*\d{4})*,?\s+)(?:by\s+)?(?P<who>[^\n]*)", re.I)
_FOREIGN = re.compile(r"\bimported copy\b|\bis a (?:fork|copy|port) of\b|\btaken (?:verbatim )?from\b|\bcopied (?:verbatim )?from\b|\bvendored (?:copy|from)\b|\bthird[- ]party (?:copy|code|source)\b|\bsend patches upstream\b|\bforked from\b", re.I)
_VENDORED = re.compile(r"(?:^|/)(?:vendor|node_modules|bower_components|third[_-]?party|3rd[_-]?party|external|externals|deps)/", re.I)
_DIRECTIVE = re.compile(r"^(?:go:|\+build|eslint|tslint|ts-|@ts-|prettier|jshint|jslint|istanbul|nolint|#!|-\*-|<\?|/?>|tool:|package\b|import\b)", re.I)
_LICENCE = re.compile(r"copyright|\(c\)|licen[cs]e|spdx|all rights reserved|internal source|authors|version|^v?\d", re.I)


def preamble(body: str) -> str:
    return _PREAMBLE.match(body).group()


def _blocks(text: str) -> list[list[str]]:
    """Comments of a preamble as lists of lines; a blank or unmarked line ends a run of // lines."""
    out: list[list[str]] = []
    for m in re.finditer(r"/\*(.*?)\*/|<!--(.*?)-->|((?:^[ \t]*(?://|#)[^\n]*(?:\n|\Z))+)", text, re.S | re.M):
        raw = m.group(1) or m.group(2) or m.group(3) or ""
        out.append([re.sub(r"^[ \t]*(?://+|\*+|#+)?[ \t!]*", "", x).strip() for x in raw.replace("\r", "").split("\n")])
    return out


def notice(body: str, module_path: str | None) -> str:
    """What the header says: 'tool', 'kept' (by hand), 'banner' (of minified code), 'foreign', 'own' or ''.

    A tool's notice has to lead its comment, after licence lines and directives;
    within prose it is only spoken of.
    """
    head = preamble(body)
    if not head.strip():
        return ""
    blocks = _blocks(head)
    plain = "\n".join("\n".join(b) for b in blocks)
    if _KEPT.search(plain):
        return "kept"
    for block in blocks:
        for line in block:
            if not line or _DIRECTIVE.match(line) or _LICENCE.search(line) and not _TOOL.match(line):
                continue
            if _TOOL.match(line):
                return "tool"
            break
    if _FOREIGN.search(plain):
        return "foreign"
    org = re.split(r"[./\\]", (module_path or "").lower(), maxsplit=1)[0]
    holders = [m.group("who").lower() for m in _HOLDER.finditer(plain)]
    if holders and org and not any(org in h for h in holders):
        return "foreign"
    if head.lstrip().startswith("/*!"):
        return "banner"
    return "own" if holders else ""


def below_module(file_name: str | None, module_path: str | None) -> str:
    name, module = (file_name or "").replace("\\", "/"), (module_path or "").replace("\\", "/").rstrip("/")
    return name[len(module) + 1 :] if module and name.startswith(module + "/") else name


def third_party(body: str, file_name: str | None, module_path: str | None) -> bool:
    """By place or notice."""
    return bool(_VENDORED.search(below_module(file_name, module_path))) or notice(body, module_path) == "foreign"


@lru_cache(maxsize=500_000)
def _word_hash(word: str) -> int:
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) | zlib.adler32(b[::-1]) << 32


def shingles(body: str) -> np.ndarray:
    """Distinct hashes of five words of code, without comments and package clause; a shorter text is one shingle."""
    words = _PACKAGE.sub("", _COMMENTS.sub("", body.replace("\r\n", "\n"))).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    out = np.zeros(max(1, len(h) - WORDS + 1), dtype=np.uint64)
    for i in range(min(WORDS, len(h))):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - min(WORDS, len(h)) + 1 + i]) ^ (out >> np.uint64(29))
    return np.unique(out).astype(np.int64)


def features(body: str) -> list[float]:
    """FEATURES of a body without its header."""
    code = body[len(preamble(body)) :]
    if not code.strip():
        code = body
    raw = code.encode("utf-8", "surrogatepass")
    bare = _COMMENTS.sub("", code)
    counts = Counter(_TOKENS.findall(bare))
    total = sum(counts.values()) or 1
    inside = signs = digits = n_id = letters = short = long = idents = 0
    for t, n in counts.items():
        c, k = t[0], len(t)
        if c.isalpha() or c in "_$":
            n_id, idents, letters = n_id + n, idents + 1, letters + k * n
            short, long = short + n * (k <= 2), long + n * (k >= 12)
            signs += k * n
        elif c in "\"'`" or c.isdigit():
            inside, signs = inside + k * n, signs + k * n
            digits += k * n if c.isdigit() else 0
        elif c not in _SIGNS:
            signs += k * n
    n_id = n_id or 1
    lines = code.split("\n")
    lengths = [len(x) for x in lines]
    distinct = len({x.strip() for x in lines})
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        -sum(n / total * math.log2(n / total) for n in counts.values()),
        letters / n_id,
        short / n_id,
        long / n_id,
        idents / n_id,
        1 - len(bare) / max(1, len(code)),
        sum(lengths) / len(lengths),
        float(max(lengths)),
        min(1.0, inside / max(1, signs)),
        digits / max(1, len(bare)),
        sum(1 for x in lengths if x == 0) / len(lengths),
        1 - distinct / len(lines),
        _dense_share(bare, max(lengths)),
    ]


def is_data(f: list[float]) -> bool:
    """Literals and next to nothing else, whatever the file's size."""
    return f[FEATURES.index("literal_share")] >= DATA_SHARE


def is_minified(f: list[float]) -> bool:
    """Most of the code, literals aside, on very long lines without blanks between words and signs."""
    return f[FEATURES.index("dense_share")] >= MINIFIED_SHARE


def _dense_share(bare: str, longest: int) -> float:
    if longest < LONG_LINE:
        return 0.0
    lines = _LITERALS.sub("0", bare).split("\n")
    dense = sum(len(x) for x in lines if len(x) >= LONG_LINE and x.count(" ") < 0.12 * len(x))
    return dense / max(1, sum(map(len, lines)))


def _positions(hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - FILTER_BITS)


def _third_party_shingles(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for b in batches:
            parts = []
            for name, module, body in zip(b["file_name"], b["module_path"], b["body"]):
                if third_party(body, name, module):
                    h = shingles(body)
                    key = h.tobytes()
                    if key not in seen:  # a copy of a copy adds nothing
                        if len(seen) < 100_000:  # bounds the memory only: what is not remembered is given again, and distinct() removes it
                            seen.add(key)
                        parts.append(h)
            yield pd.DataFrame({"shingle": np.concatenate(parts) if parts else np.zeros(0, np.int64)})

    return stash(files.mapInPandas(run, "shingle long").distinct(), "third-party")


def _filter(known: DataFrame) -> np.ndarray:
    """A bit set of fixed size over the third-party shingles."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = _positions(b["shingle"].to_numpy())
            yield pd.DataFrame({"word": (at >> np.uint64(5)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(31))).astype(np.int64)})

    rows = known.mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most 2**20 rows
    bits = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return bits


_FACTS = "file_id long, notice string, placed boolean, data boolean, minified boolean, maybe_copy boolean, features array<double>"


def facts(files: DataFrame, known: DataFrame) -> DataFrame:
    """One row per file with a body; everything that one reading of its text gives."""
    shared = files.sparkSession.sparkContext.broadcast(_filter(known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for b in batches:
            rows = []
            for i, name, module, body in zip(b["file_id"], b["file_name"], b["module_path"], b["body"]):
                said, placed = notice(body, module), bool(_VENDORED.search(below_module(name, module)))
                f = features(body)
                copy = False
                if said not in ("tool", "foreign") and not placed:
                    h = shingles(body)
                    if len(h):
                        at = _positions(h)
                        copy = bool(((bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1).mean() >= COPY_SHARE)
                rows.append((i, said, placed, is_data(f), is_minified(f), copy, f))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FACTS.split(", ")])

    return stash(files.mapInPandas(run, _FACTS), "file-facts")


def copies(files: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """file_id of the candidates with at least COPY_SHARE of their shingles in third-party code, counted exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(i, shingles(body)) for i, body in zip(b["file_id"], b["body"])]
            yield pd.DataFrame({"file_id": np.repeat([i for i, _ in parts], [len(h) for _, h in parts]), "n": np.repeat([len(h) for _, h in parts], [len(h) for _, h in parts]), "shingle": np.concatenate([h for _, h in parts]) if parts else np.zeros(0, np.int64)})

    mine = files.join(candidates.select("file_id"), "file_id", "left_semi").mapInPandas(run, "file_id long, n long, shingle long")
    return mine.join(known, "shingle", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= COPY_SHARE * F.col("n")).select("file_id")


def train(read: DataFrame, limit: int = TRAINING_FILES):
    """The forest, or None where too few files carry a notice. Notices of tools and third parties and banners against
    own and kept notices; a copy in a third party's folder is labelled as its notice would."""
    label = F.when(F.col("notice").isin("tool", "banner", "foreign") | F.col("placed"), 1.0).when(F.col("notice").isin("own", "kept"), 0.0)
    labelled = read.withColumn("label", label).where(F.col("label").isNotNull()).select("label", "features", F.xxhash64("file_id").alias("h"), "file_id")
    parts = [labelled.where(F.col("label") == k).orderBy("h", "file_id").limit(limit) for k in (0.0, 1.0)]
    sample = stash(parts[0].unionByName(parts[1]).select("label", array_to_vector("features").alias("vector")).coalesce(1), "labelled")
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(found.get(0.0, 0), found.get(1.0, 0)) < LEAST_TRAINING:
        return None
    return RandomForestClassifier(labelCol="label", featuresCol="vector", probabilityCol="chance", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2).fit(sample)


def judged(files: DataFrame) -> DataFrame:
    """(file_id, reason, chance): the files nobody wrote by hand, each with the first reason that holds.

    Reasons: forest, third-party (a notice or a place), tool (a notice), data,
    minified, copy. A notice that hand-work has taken over ("kept by hand")
    outweighs the forest but no exact check. Null, empty and blank bodies are no
    cases. A file delivered again is judged again; an empty table gives no rows.
    """
    bodies = spread(files.select("file_id", "file_name", "module_path", "body").where(F.col("body").rlike(r"\S")))
    known = _third_party_shingles(bodies.drop("file_id"))
    read = facts(bodies, known)
    same = stash(copies(bodies, read.where("maybe_copy"), known), "third-party-copies").withColumn("same", F.lit(True))  # training and scoring read it
    # a third party's own files lie in its code by what they are; of the others that is counted
    own = (F.col("notice") == "foreign") | F.col("placed") | F.col("same")
    read = read.join(same, "file_id", "left").withColumn("features", F.concat("features", F.array(F.when(own, 1.0).otherwise(0.0))))
    model = train(read)
    scored = read.withColumn("chance", F.lit(0.0))
    if model is not None:
        scored = model.transform(read.withColumn("vector", array_to_vector("features"))).withColumn("chance", vector_to_array("chance")[1])
    reason = (
        F.when((F.col("chance") >= TOOL_PROBABILITY) & (F.col("notice") != "kept"), "forest")
        .when((F.col("notice") == "foreign") | F.col("placed"), "third-party")
        .when(F.col("notice") == "tool", "tool")
        .when(F.col("data"), "data")
        .when(F.col("minified"), "minified")
        .when(F.col("same"), "copy")
    )
    return scored.select("file_id", reason.alias("reason"), "chance").where("reason IS NOT NULL")
