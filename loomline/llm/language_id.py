"""Language of web pages by Bayesian evidence fusion.

For each page, log posteriors add up from: the text's likelihood under character trigrams of each language; the language declared in the
markup, by how often pages whose text is in l declare it; the address suffix, likewise; and the host's prior, smoothed towards
its domain's and that towards all pages' (each level counts as `strength` pages of the level above). The text's likelihood is that of WORDS words at most: as words of one text are not independent, the
mean of a longer one's words is taken WORDS times; every word counts in that mean. All counts are sums of the text's
posteriors over all pages by grouped aggregation; a page's own contribution is taken out of its host's counts.

The trigram model is fitted on a bounded sample of texts with known language (SAMPLE, in hash order of the key) and has GRAMS rows at most, of
which each language has an equal share if it needs it: every language of the sample is told apart. Runs of letters are taken whole.

A null or empty page has no text: its other evidence decides. A null address has the host "". An undeclared language is a value of its own.
Without any labelled text, or with one language only, every page gets what is known: null, or that language. Repeated rows count each.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, attach, batch, key_columns, scoped, written

#: Labelled texts in the fit, and trigram rows kept, at most.
SAMPLE, GRAMS = 8_000, 60_000
#: Letters of the words that are cached; longer runs, as in scripts without spaces, are computed each time.
CACHED = 32
#: Pages that a level's parent counts for.
STRENGTH = 5.0
#: Words whose likelihood counts in full; more words are scaled down to these, as words of one text are not independent.
WORDS = 40

_OPENING = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\slang\s*=\s*[\"']?\s*([a-z]{2,8})", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def visible(page: str) -> str:
    """Text of a page without markup, comments and elements that are not shown; one that never ends hides nothing. Linear in the page: an end that is not found is not sought again."""
    parts, at, seek, endless = [], 0, 0, set()
    while opening := _OPENING.search(page, seek):
        name = (opening[1] or "").lower()
        closing = None if name in endless else _CLOSING[name].search(page, opening.end())
        if closing:
            parts.append(page[at : opening.start()])
            at = seek = closing.end()
        else:
            endless.add(name)
            seek = opening.end()
    shown = " ".join([*parts, page[at:]])
    last = shown.rfind(">") + 1
    return markup.unescape(_TAG.sub(" ", shown[:last]) + shown[last:])


def declared(page: str) -> str:
    for tag in _HTML.finditer(page):
        if found := _LANG.search(tag[0]):
            return found[1].lower()
    return ""


def host_parts(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last two names) and suffix (its last name)."""
    found = _HOST.match(url or "")
    host = found[1].lower().rstrip(".") if found else ""
    names = host.split(".")
    return host, ".".join(names[-2:]), names[-1]


GRAM_ROWS = "lang string, gram string, n long"


def gram_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> list:
    """Rows (lang, gram, n) of a bounded sample of labelled texts; one partial sum per task before the shuffle."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("doc_id"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), "lang").distinct()
    some = key_columns(docs, key, text).join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in batches:
            for name, value in zip(part.column(0).to_pylist(), part.column(1)):
                words = Counter(_LETTERS.findall(value.as_py().lower()))
                for word, n in words.items():
                    padded = f" {word} "
                    for i in range(len(padded) - 2):
                        found[name, padded[i : i + 3]] += n
        keys = list(found)
        yield batch(GRAM_ROWS, lang=[k[0] for k in keys], gram=[k[1] for k in keys], n=[found[k] for k in keys])

    counts = some.mapInArrow(run, GRAM_ROWS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "lang", "gram").limit(GRAMS + 1).collect()
    if len(found) <= GRAMS:
        return found
    # Each language keeps its share of the rows, so that none is lost to the frequent ones; what others leave is filled by count.
    share = max(1, GRAMS // counts.select("lang").distinct().count())
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return ranked.orderBy(F.col("rank") > share, F.desc("n"), "lang", "gram").limit(GRAMS).drop("rank").collect()


class TextModel:
    """Log likelihood of a text in each language."""

    def __init__(self, rows: list):
        totals: Counter = Counter()
        for r in rows:
            totals[r.lang] += r.n
        self.languages = sorted(totals)
        place = {x: i for i, x in enumerate(self.languages)}
        self.grams: dict[str, np.ndarray] = {}
        kinds = {r.gram for r in rows}
        base = np.array([totals[x] + 0.5 * len(kinds) for x in self.languages], float)
        for r in rows:
            if r.gram not in self.grams:
                self.grams[r.gram] = np.full(len(self.languages), 0.5)
            self.grams[r.gram][place[r.lang]] += r.n
        self.grams = {k: np.log(v / base) for k, v in self.grams.items()}
        self.unknown = np.log(0.5 / base) if len(base) else base
        self.words: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is None:
            padded = f" {word} "
            known = sum((self.grams.get(padded[i : i + 3], self.unknown) for i in range(len(padded) - 2)), np.zeros(len(self.languages)))
            if len(word) <= CACHED:
                if len(self.words) >= CACHE_ENTRIES // 2:
                    self.words.clear()
                self.words[word] = known
        return known

    def posterior(self, text: str) -> np.ndarray:
        """Even where there is no text."""
        words = _LETTERS.findall(text.lower())
        score = sum(map(self.word, words), np.zeros(len(self.languages))) * min(1.0, WORDS / max(1, len(words)))
        p = np.exp(score - score.max())
        return 0.999 * p / p.sum() + 0.001 / len(p)


@scoped
def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", strength: float = STRENGTH) -> DataFrame:
    """Per row: page_id, language, probability, text_language, text_probability, declared, suffix, host."""
    model_rows = gram_counts(docs)
    model = TextModel(model_rows)
    languages = model.languages
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    fields = [f"p{i}" for i in range(len(languages))]
    schema = "page_id long, declared string, host string, domain string, suffix string" + "".join(f", {f} double" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextModel(model_rows)
        for rows in batches:
            said, hosts, chances = [], [], []
            for address, page in zip(rows.column(1).to_pylist(), rows.column(2)):
                text = page.as_py()
                said.append(declared(text))
                hosts.append(host_parts(address))
                chances.append(own.posterior(visible(text)) if languages else [])
            host, domain, suffix = (list(x) for x in zip(*hosts)) if hosts else ([], [], [])
            p = np.array(chances).reshape(len(said), len(languages))
            yield batch(schema, page_id=rows.column(0), declared=said, host=host, domain=domain, suffix=suffix, **{f: p[:, i] for i, f in enumerate(fields)})

    facts = written(source.mapInArrow(run, schema), "pages")
    if not languages:
        none = F.lit(None).cast("string")
        return facts.select("page_id", none.alias("language"), F.lit(None).cast("double").alias("probability"), none.alias("text_language"), F.lit(None).cast("double").alias("text_probability"), "declared", "suffix", "host")

    sums = lambda df, keys, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), *(F.sum(f).alias(f"{name}_{f}") for f in fields))
    by_host = written(sums(facts, ["host", "domain"], "host"), "hosts")
    by_domain = written(by_host.groupBy("domain").agg(F.count(F.lit(1)).alias("hosts"), F.sum("host_n").alias("domain_n"), *(F.sum(f"host_{f}").alias(f"domain_{f}") for f in fields)), "domains")
    everything = facts.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in fields)).collect()[0]
    total = everything.n
    shares = [((everything[f] or 0.0) + 1.0) / (total + len(fields)) for f in fields]
    # A domain may have very many hosts, a host very many pages.
    hosts = attach(by_host, by_domain, "domain", "hosts", by_host.count()).drop("domain", "hosts")
    rows = attach(facts, hosts, "host", "host_n", total)
    for name in ("declared", "suffix"):
        found = written(sums(facts, [name], name), name)
        rows = attach(written(rows, f"pages-{name}"), found, name, f"{name}_n", total)

    scores = []
    for i, f in enumerate(fields):
        parent = F.lit(shares[i])
        domain = (F.col(f"domain_{f}") - F.col(f) + strength * parent) / (F.col("domain_n") - 1 + strength)
        prior = (F.col(f"host_{f}") - F.col(f) + strength * domain) / (F.col("host_n") - 1 + strength)
        mass = everything[f] or 0.0
        seen = lambda name: (F.col(f"{name}_{f}") + 0.1) / F.lit(mass + 1.0)
        scores.append(F.log(F.col(f)) + F.log(F.greatest(prior, F.lit(1e-9))) + F.log(seen("declared")) + F.log(seen("suffix")))
    best = F.greatest(*scores, F.lit(-1e300))
    weights = [F.exp(s - F.col("_best")) for s in scores]
    total_weight = sum(weights[1:], weights[0])
    top = lambda columns, value: F.coalesce(*(F.when(c >= value, F.lit(x)) for c, x in zip(columns, languages)))
    text_best = F.greatest(*(F.col(f) for f in fields), F.lit(0.0))
    return rows.withColumn("_best", best).select(
        "page_id",
        top(scores, F.col("_best")).alias("language"),
        (F.lit(1.0) / total_weight).alias("probability"),
        top([F.col(f) for f in fields], text_best).alias("text_language"),
        text_best.alias("text_probability"),
        "declared",
        "suffix",
        "host",
    )
