"""Texts damaged by a wrong decoding: found, explained by an encoding chain, restored.

A multinomial classifier over hashed byte bigrams is trained on words of the
documents, sound and garbled along every known chain. A word it gives to a
chain is inverted; the result must decode strictly and read like sound text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.common import spread, stash
from strataq.llm.encodings import CHAINS, NAMES, garble, restore

BUCKETS = 1 << 14
#: Documents with other than ASCII characters that the classifier is fitted on, the least by a hash of their id.
TRAINING_DOCUMENTS = 5000
SOUND = len(NAMES)  # the class of sound words
#: Chains whose bytes had to decode as UTF-8, which other text hardly ever does.
STRICT = [all(right == "utf-8" and wrong != "ascii" for right, wrong in CHAINS[n]) for n in NAMES]
#: Log odds a word needs for its chain, where bytes had to decode as UTF-8 (unlikely by chance) and elsewhere, and a whole text needs in the latter case.
ODDS_STRICT, ODDS_WORD, ODDS_TEXT = -1.0, 2.0, 5.0
#: A word that could be written as it stands needs far more: its own odds, a gain per bigram, and this many such words with these odds in a text.
ODDS_NATURAL, GAIN_NATURAL, WORDS_NATURAL, ODDS_TEXT_NATURAL = 8.0, 2.0, 3, 40.0
#: Words that agree on one chain reach ODDS_TEXT_NATURAL in any number; words with letters that are rare in the text's sound words, where their inverses have common ones, need less.
ODDS_TEXT_FOREIGN = 20.0
#: What a word in capitals that looks natural gains per bigram, both read in small letters; the sum is its odds.
GAIN_CAPITALS = 0.5
_SPLIT = re.compile(r"[ \t\r\n\f\v]+")
_INLINE = re.compile(r"`[^`\n]*`")
#: Signs that may stand between letters of a sound word.
_JOINING = frozenset("'’‘‐‑–—…/·-+._:@#&*=|,;()[]{}<>\\~^%$!?\"“”«»×→←↔↦、。・「」『』（）！？：；～…\u00ad\u200b\u200c\u200d")


def unnatural(word: str) -> bool:
    """Whether letters of the word meet as no writer joins them: a sign within a word, a capital after a small
    letter, a letter after a superscript one, two alphabets in one word, or control characters. Only marks beyond ASCII count."""
    before, kind_before = "", ""
    for i, c in enumerate(word):
        if c < "\x80" or c.isalpha():
            kind = "" if not c.isalpha() else "latin" if c < "\u0250" or "\u1e00" <= c < "\u1f00" else "greek" if "\u0370" <= c < "\u0400" else "cyrillic" if "\u0400" <= c < "\u0530" else "other"
            if kind and kind_before:
                if before in "ⁿⁱ":
                    return True
                high = c > "\x7f" or before > "\x7f"
                if high and c.isupper() and before.islower() and before not in "µªº":
                    return True
                if kind != kind_before and "other" not in (kind, kind_before) and before != "µ":
                    return True
            before, kind_before = c, kind
            continue
        if "\x80" <= c < "\xa0":
            return True
        after = word[i + 1 : i + 2]
        if kind_before and after.isalpha() and c not in _JOINING and not c.isspace():
            return True
        before, kind_before = c, ""
    return False


def letters(word: str) -> set[str]:
    """Its letters beyond ASCII, small."""
    return {c for c in word.lower() if c > "\x7f" and c.isalpha()}


def bigrams(word: str) -> np.ndarray:
    """Buckets of the byte bigrams that hold a byte above ASCII."""
    b = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.uint32)
    x = (b[:-1] << 8) | b[1:]
    return (((x[((b[:-1] | b[1:]) & 128) > 0] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)) & (BUCKETS - 1)


def unquoted(text: str) -> str:
    """The text without what stands between backquotes on one line."""
    return _INLINE.sub(" ", text)


def high_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if not w.isascii()]


def _looks_read_twice(word: str) -> bool:
    """A word that UTF-8 bytes explain strictly; such words are no examples of sound ones."""
    if "�" in word:
        return True
    return any(restore(word, CHAINS[f"utf-8>{e}"]) not in (None, word) for e in ("cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "cp850", "cp437"))


def train(documents: DataFrame, limit: int = TRAINING_DOCUMENTS) -> np.ndarray:
    """Log probabilities, classes x buckets (the last class is sound). A fixed size, about 6 MB."""
    chosen = documents.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("text", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(limit).select("text", "h")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(NAMES) + 1, BUCKETS), dtype=np.int64)
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(high_words(unquoted(text)))
        for word, n in seen.items():
            if _looks_read_twice(word):
                continue
            n = min(n, 50)
            np.add.at(total[SOUND], bigrams(word), n)
            for k, name in enumerate(NAMES):
                bad = garble(word, CHAINS[name])
                if bad is not None and bad != word:
                    np.add.at(total[k], bigrams(bad), n)
        c, f = np.nonzero(total)
        yield pd.DataFrame({"c": c, "f": f, "n": total[c, f]})

    parts = stash(chosen, "garbling-sample").repartition(8, "h")
    counts = parts.mapInPandas(count, "c long, f long, n long").groupBy("c", "f").agg(F.sum("n").alias("n")).toPandas()  # at most classes x buckets
    table = np.zeros((len(NAMES) + 1, BUCKETS))
    table[counts["c"], counts["f"]] = counts["n"]
    smooth = 0.05
    return np.log((table + smooth) / (table.sum(axis=1, keepdims=True) + smooth * BUCKETS)).astype(np.float32)


class Judge:
    """Decides words with a trained table; remembers its verdicts."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = np.ascontiguousarray(table.T), {}

    def score(self, word: str) -> tuple[np.ndarray, int]:
        ids = bigrams(word)
        return self.table[ids].sum(axis=0), len(ids)

    def _small(self, word: str) -> float:
        """How sound the word reads in small letters, per bigram."""
        s, n = self.score(word.lower())
        return float(s[SOUND]) / n if n else -np.inf

    def word(self, word: str) -> tuple[str, float, str | None] | None:
        """(chain, log odds against sound, the word restored or None where bytes are lost); None for a sound word."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._word(word)
        return self.known[word]

    def _word(self, word: str) -> tuple[str, float, str | None] | None:
        s, n = self.score(word)
        odds = s - s[SOUND]
        if "�" in word:  # what a decoder writes for bytes it could not read
            k = int(np.argmax(odds[:SOUND]))
            return NAMES[k], 99.0, None
        here, odd = s[SOUND] / max(n, 1), unnatural(word)
        for k in sorted(np.argsort(-odds[:SOUND])[:10], key=lambda k: (not STRICT[k], -odds[k])):
            if odds[k] < (ODDS_STRICT if STRICT[k] else ODDS_WORD if odd else ODDS_NATURAL):
                continue
            back = restore(word, CHAINS[NAMES[k]])
            if back is None or back == word or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in back) or not STRICT[k] and unnatural(back):
                continue
            t, m = self.score(back)
            if not STRICT[k] and not odd and (not m or t[SOUND] / m < here + GAIN_NATURAL):
                continue
            sure = float(odds[k])
            if not STRICT[k] and not odd and word.isupper():  # capitals are rare in any case; what tells is which of the two reads better in small letters
                gain = self._small(back) - self._small(word)
                if gain < GAIN_CAPITALS:
                    continue
                sure = min(sure, gain * n)
            if m and t[SOUND] / m < here + 0.5:
                deeper = self._word(back) if len(back) < len(word) else None
                if deeper is None or deeper[2] is None:
                    continue
                back = deeper[2]
            return NAMES[k], sure, back
        return None

    def evidence(self, text: str | None) -> tuple[str, float, bool] | None:
        """(chain, log odds, whether words that look natural count) of a damaged text, else None. Null, empty and ASCII texts are sound."""
        if not text or text.isascii():
            return None
        odds: Counter[str] = Counter()
        plain: dict[str, tuple[str, float, str]] = {}
        own: Counter[str] = Counter()
        sure, marked = False, 0.0
        for w in high_words(unquoted(text)):
            got = self.word(w)
            if got is None:
                own.update(letters(w))
                continue
            odds[got[0]] += got[1]
            if got[2] is None or STRICT[NAMES.index(got[0])]:
                sure = True
            elif unnatural(w):
                marked += got[1]
            else:
                plain[w] = got
        many = len(plain) >= WORDS_NATURAL and sum(x for _, x, _ in plain.values()) >= ODDS_TEXT_NATURAL
        alike: Counter[str] = Counter()
        foreign = 0.0
        for w, (name, x, back) in plain.items():
            mine, theirs = letters(w), letters(back)
            if mine:  # a no-break space alone is no letter
                alike[name] += x
                here, there = mine - theirs, theirs - mine
                foreign += x if here and there and min(own[c] for c in there) > 3 * max(own[c] for c in here) else 0.0
        many = many or max(alike.values(), default=0.0) >= ODDS_TEXT_NATURAL or foreign >= ODDS_TEXT_FOREIGN
        if not (sure or marked >= ODDS_TEXT or many):
            return None
        chain, best = odds.most_common(1)[0]
        return chain, float(best), many

    def text(self, text: str | None) -> tuple[str, float] | None:
        got = self.evidence(text)
        return got and got[:2]

    def _mended(self, word: str, plain: bool) -> str | None:
        """The word restored, or None where it is sound or beyond help."""
        got = None if word.isascii() else self.word(word)
        if got is None or not plain and not unnatural(word) and not STRICT[NAMES.index(got[0])]:
            return None
        return got[2]

    def restored(self, text: str) -> str:
        """The text with every line or, where a line is only damaged in part, every word inverted."""
        found = self.evidence(text)
        if found is None:
            return text
        chain, _, plain = found
        out = []
        for line in text.split("\n"):
            for _ in range(3):
                if all(self._mended(w, plain) is None for w in high_words(line)):
                    break
                whole = restore(line, CHAINS[chain]) if "�" not in line else None
                if whole is not None and all(self._mended(w, plain) is None for w in high_words(unquoted(whole))):
                    line = whole
                    break
                fixed = "".join(self._mended(w, plain) or w for w in re.split(r"([ \t\r\n\f\v]+)", line))
                if fixed == line:
                    break
                line = fixed
            out.append(line)
        return "\n".join(out)


def find_garbled(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, chain, odds[, restored, complete]): one row per damaged document.

    complete is false where bytes are lost (replacement characters remain).
    Every document is judged as a whole text; a repeated row gives its row
    again; an empty table gives no rows.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(documents))
    schema = "doc_id long, chain string, odds double" + (", restored string, complete boolean" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"]):
                got = judge.text(text)
                if got is None:
                    continue
                if with_text:
                    back = judge.restored(text)
                    rows.append((i, *got, back, judge.text(back) is None))
                else:
                    rows.append((i, *got))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spread(documents.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))).mapInPandas(run, schema)
