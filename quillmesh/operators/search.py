"""Full-text search: tokens, stems, prefix-OR match, phrases by position, weighted BM25.

`Matcher` turns postings (docid, len, col, pos, stem) into scores; where they come from is up to its two forms.
`SearchIndex` reads the texts themselves: rows are tokenised once and only words that may have a wanted stem
become rows and are stemmed, by an Arrow UDF. `stored_index.StoredIndex` keeps postings as tables and
reads those of a query's terms. Texts and queries go through one tokeniser (`TOKEN`, in lower case) and one `fold`.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

# Column weights, synonyms.
WEIGHTS = {"subject": 10.0, "sender": 8.0, "recipients": 4.0, "body": 1.0}
SYNONYMS = {
    "invoice": ["receipt", "bill"],
    "receipt": ["invoice", "bill"],
    "bill": ["invoice", "receipt"],
    "flight": ["airfare", "itinerary"],
    "airfare": ["flight", "itinerary"],
    "refund": ["reimbursement", "credit"],
}
K1, B = 1.2, 0.75


def expand_query(terms: list[str]) -> list[str]:
    """Each term followed by its synonyms; repeats (in any case) dropped."""
    out: dict[str, str] = {}
    for word in (w for t in terms for w in (t, *SYNONYMS.get(t.lower(), ()))):
        out.setdefault(word.lower(), word)
    return list(out.values())


def build_match(terms: list[str], expand: bool = False) -> str:
    """The terms as an OR of quoted prefixes."""
    words = [t.strip() for t in (expand_query(terms) if expand else terms)]
    return " OR ".join('"' + w.replace('"', '""') + '"*' for w in words if w)


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _measure(stem: str) -> int:
    """The number of vowel-consonant sequences."""
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") for i, c in enumerate(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiou"


def _cvc(word: str) -> bool:
    if len(word) < 3 or word[-1] in "wxy":
        return False
    v = [c in "aeiou" or (c == "y" and i > 0 and word[i - 1] not in "aeiou") for i, c in enumerate(word)]
    return not v[-3] and v[-2] and not v[-1]


# The suffix tables of the published stemmer, steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """The Porter stem of a lower-case ASCII word; others are returned as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and _vowel(word[: -len(x)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        suffix = max((x for x in table if word.endswith(x)), key=len, default=None)
        if suffix and _measure(word[: -len(suffix)]):
            word = word[: -len(suffix)] + table[suffix]
    suffix = max((x for x in STEP4 if word.endswith(x)), key=len, default=None)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@pandas_udf(StringType())
def stem_udf(s: pd.Series) -> pd.Series:
    known = {w: porter(fold(w)) for w in s.dropna().unique()}
    return pd.Series([known.get(w) for w in s], dtype=object)


def stem_among(starts: tuple[str, ...]):
    """The stems of words that begin (folded) as told; null for others, which are not stemmed."""

    @pandas_udf(StringType())
    def stems(s: pd.Series) -> pd.Series:
        folded = {w: w if w.isascii() else fold(w) for w in s.dropna().unique()}
        found = {w: porter(f) for w, f in folded.items() if f.startswith(starts)}
        return pd.Series([found.get(w) for w in s], dtype=object)

    return stems.asNondeterministic()  # evaluated once, not again in a filter below


TOKEN = r"([\p{L}\p{N}\p{Co}\p{Mn}]+)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 1)


def phrase_tokens(phrase: str) -> list[str]:
    """A query's words, split as texts are; a word of marks alone is none."""
    return [w for w in regex.findall(TOKEN, phrase.lower()) if fold(w)]


def maybe_stems_to(token: Column, keys: list[tuple[str, bool]]) -> Column:
    """False only if the token's stem can be none of the keys (nor begin with one, where its flag is set): stemming changes no more than a word's end, of which at most the last letter of the stem is new, and folding changes no ASCII letter. One pattern for all keys."""
    starts = sorted({k if prefix and len(k) < 2 else k[:-1] for k, prefix in keys})
    return token.rlike("^(?:" + "|".join(map(re.escape, starts)) + r")|[^\x00-\x7F]")


class Matcher:
    """Phrases against postings. Subclasses give `totals` and `found`."""

    weights: dict[str, float]
    stem: bool

    def totals(self) -> DataFrame:
        """One row: n_docs, avg_len."""
        raise NotImplementedError

    def found(self, keys: list[list[str]], prefix: bool) -> DataFrame:
        """(docid, len, col, pos, stem): at least the postings whose stem a phrase names."""
        raise NotImplementedError

    def keys(self, phrases: list[str]) -> list[list[str]]:
        return [[porter(fold(w)) if self.stem else w for w in words] for words in map(phrase_tokens, phrases) if words]

    def hits(self, keys: list[list[str]], prefix: bool) -> DataFrame:
        """(docid, len, col, phrase, tf): phrases as stems at consecutive positions of one column, the last one as a prefix."""
        tests = [
            F.when(F.col("stem").startswith(key) if prefix and i == len(words) - 1 else F.col("stem") == key, F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("part")))
            for p, words in enumerate(keys)
            for i, key in enumerate(words)
        ]
        rows = self.found(keys, prefix).select("docid", "len", "col", "pos", F.explode(F.array_compact(F.array(*tests))).alias("m"))
        rows = rows.select("docid", "len", "col", "m.phrase", "m.part", (F.col("pos") - F.col("m.part")).alias("start"))
        if max(map(len, keys)) > 1:
            sizes = F.element_at(F.array(*[F.lit(len(words)) for words in keys]), F.col("phrase") + 1)
            rows = rows.groupBy("docid", "len", "col", "phrase", "start").agg(F.countDistinct("part").alias("n")).where(F.col("n") == sizes)
        return rows.groupBy("docid", "len", "col", "phrase").agg(F.count("*").alias("tf"))

    def matching(self, phrases: list[str], prefix: bool = False) -> DataFrame:
        """(docid): documents with any of the phrases."""
        keys = self.keys(phrases)
        return self.hits(keys, prefix).select("docid").distinct() if keys else self._none().select("docid")

    def search(self, phrases: list[str], prefix: bool = True) -> DataFrame:
        """(docid, score): documents with any phrase; the score is negative, the best one is the smallest."""
        keys = self.keys(phrases)
        return self.scored(self.hits(keys, prefix)) if keys else self._none()

    def scored(self, hits: DataFrame, df: DataFrame | None = None) -> DataFrame:
        """Scores of hits; df (phrase, df) where the hits are not all there are."""
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv]), F.col("col"))
        rows = hits.groupBy("docid", "len", "phrase").agg(F.sum(weight * F.col("tf")).alias("f"))
        df = rows.groupBy("phrase").agg(F.count("f").alias("df")) if df is None else df  # of f, so that both branches share one shuffle
        idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = -F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        rows = rows.join(F.broadcast(df), "phrase").join(F.broadcast(self.totals()))  # a row for each phrase, and one
        return rows.groupBy("docid").agg(F.sum(part).alias("score"))

    def _none(self) -> DataFrame:
        return self.totals().select(F.lit("").alias("docid"), F.lit(0.0).alias("score")).limit(0)


class SearchIndex(Matcher):
    """docs: docid and one text column per weighted column."""

    def __init__(self, docs: DataFrame, weights: dict[str, float] | None = None, stem: bool = True) -> None:
        self.weights = dict(weights or WEIGHTS)
        self.stem = stem
        size = sum((F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN)) for c in self.weights), F.lit(0)).cast("long")
        self.lengths = docs.select("docid", size.alias("len"))
        self.docs, self.size = docs, size  # len not by words, or these would go along with each word

    @staticmethod
    def _placed(name: str) -> Column:
        return F.transform(tokens(F.col(name)), lambda t, i: F.struct(F.lit(name).alias("col"), i.alias("pos"), t.alias("token")))

    def totals(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))

    def _may_hold(self, whole: set[str], last: set[str]) -> Column:
        """False only of rows without a wanted word, by a look for what such a word begins with; other rows are not tokenised."""
        starts = {k if k in last and len(k) < 2 else k[:-1] for k in whole | last} if self.stem else whole | last
        texts = [F.coalesce(F.col(c), F.lit("")) for c in self.weights]
        tests = [F.lower(t).contains(s) for t in texts for s in sorted(starts)]
        if self.stem:
            tests += [F.octet_length(t) > F.length(t) for t in texts]  # other letters may be folded
        return reduce(lambda a, b: a | b, tests)

    def found(self, keys: list[list[str]], prefix: bool) -> DataFrame:
        last = {words[-1] for words in keys} if prefix else set()
        whole = {k for words in keys for k in (words[:-1] if prefix else words)}
        if self.stem:
            wanted = lambda w: maybe_stems_to(w["token"], [*((k, False) for k in whole), *((k, True) for k in last)])
        else:
            wanted = lambda w: reduce(lambda a, k: a | w["token"].startswith(k), sorted(last), w["token"].isin(sorted(whole)))
        rows = self.docs.where(self._may_hold(whole, last)).select("docid", self.size.alias("len"), F.concat(*map(self._placed, self.weights)).alias("words"))
        rows = rows.select("docid", "len", F.explode(F.filter("words", wanted)).alias("w"))
        rows = rows.select("docid", "len", "w.col", "w.pos", F.col("w.token").alias("stem"))
        if not self.stem:
            return rows
        starts = tuple(sorted({k[: max(len(k) - 1, 0)] for k in whole | last}))
        kept = reduce(lambda a, k: a | F.col("stem").startswith(k), sorted(last), F.col("stem").isin(sorted(whole)))
        return rows.withColumn("stem", stem_among(starts)("stem")).where(kept)


def message_docs(messages: DataFrame, *also: str) -> DataFrame:
    """A row for each message with what is searched: docid and a text for each weighted column, and what else is asked for."""
    from ..functions.scalars import message_ref, project_body, project_recipients

    return messages.select(
        message_ref(F.col("account"), F.col("gmail_message_id")).alias("docid"), "subject", F.col("from_addr").alias("sender"), project_recipients(F.col("to_addr"), F.col("cc_addr")).alias("recipients"),
        project_body(F.col("snippet"), F.col("body_text"), F.col("summary_text")).alias("body"), *also,
    )


def index_of_messages(messages: DataFrame, stem: bool = True) -> SearchIndex:
    return SearchIndex(message_docs(messages), stem=stem)


def with_phrases(messages: DataFrame, phrases: list[str], index: Matcher | None = None, prefix: bool = False) -> DataFrame:
    """(account, gmail_message_id) of the messages with any phrase, by the index of all messages or, without one, by their own texts."""
    from ..functions.scalars import message_ref

    if index is None:  # postings that keep the message's key need no join to find it
        docs = message_docs(messages, "account", "gmail_message_id").withColumn("docid", F.struct("account", "gmail_message_id"))
        named = any(phrase_tokens(p) for p in phrases)
        return SearchIndex(docs).matching(phrases, prefix).select("docid.*") if named else docs.select("docid.*").limit(0)
    hits = index.matching(phrases, prefix)
    return messages.select("account", "gmail_message_id", message_ref(F.col("account"), F.col("gmail_message_id")).alias("docid")).join(hits, "docid", "left_semi").drop("docid")


def holds_phrase(messages: DataFrame, phrases: list[str], prefix: bool = False) -> DataFrame:
    """The messages with any phrase, row by row and without an index: for streams, whose rows cannot meet postings of their own. The same words, stems and places as `with_phrases`."""
    keys = [words for p in phrases if (words := [porter(fold(w)) for w in phrase_tokens(p)])]

    @pandas_udf(BooleanType())
    def holds(*columns: pd.Series) -> pd.Series:
        known = functools.cache(lambda w: porter(fold(w)))

        def at(stems: list[str], i: int, words: list[str]) -> bool:
            end = i + len(words) - 1
            return stems[i:end] == words[:-1] and (stems[end].startswith(words[-1]) if prefix else stems[end] == words[-1])

        def found(text: str | None) -> bool:
            stems = [known(w) for w in regex.findall(TOKEN, (text or "").lower())]
            return any(at(stems, i, words) for words in keys for i in range(len(stems) - len(words) + 1))

        return pd.Series([any(map(found, texts)) for texts in zip(*columns)], dtype=bool)

    texts = message_docs(messages.select("*", F.struct(*messages.columns).alias("__row")), "__row").select("__row", holds("subject", "sender", "recipients", "body").alias("__holds"))
    return texts.where("__holds").select("__row.*")


def bm25_reference(docs: list[dict[str, str]], words: list[str], weights: dict[str, float]) -> dict[int, float]:
    """A plain version for tests: exact single tokens, no stemming."""
    split = [{c: phrase_tokens(d.get(c) or "") for c in weights} for d in docs]
    sizes = [sum(map(len, d.values())) for d in split]
    avg, out = sum(sizes) / len(sizes), {}
    for token in words:
        f = {i: sum(w * d[c].count(token) for c, w in weights.items()) for i, d in enumerate(split)}
        f = {i: x for i, x in f.items() if x}
        idf = math.log((len(docs) - len(f) + 0.5) / (len(f) + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, x in f.items():
            out[i] = out.get(i, 0.0) - idf * x * (K1 + 1) / (x + K1 * (1 - B + B * sizes[i] / avg))
    return out
