"""Problem 8: subject areas of documents, from weighted terms matched by an automaton."""

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.stages import stage

#: The nine subjects.
SUBJECTS = ("scripts", "law", "software", "science", "medicine", "finance", "sport", "cooking", "music")
CLASSES = (*SUBJECTS, "none")
NONE = len(SUBJECTS)
#: Language codes of three letters for those of two; others count as one more language.
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "jpn": "ja"}
SPOKEN = (*sorted(set(LANGUAGES.values())), "xx")
#: Labelled sentences that are fitted on at most.
EXAMPLES = 20_000
#: Terms that an automaton holds at most; with more, sentences meet their terms in a shuffled join instead.
AUTOMATON = 500_000
#: Characters of a word that count, so that its forms are one term.
STEM = 5
#: The least that a term must say for or against a class; a term in more than one of USUAL sentences counts less.
TELLING, USUAL = 0.5, 20.0
#: Shares of the median score of held-out labelled sentences: to be counted as a subject's own, and to be given to it.
SURE, GIVEN = 0.9, 0.3

HIDDEN = re.compile("[" + "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), 0x2060, 0xFEFF))) + "]")
MARKUP = re.compile(r"<[^<>]{0,200}>|https?://\S+|www\.\S+")
END = re.compile(r"(?<=[.!?…])[\"'»”’)]*\s+|(?<=[。？！])|\n+")
#: A number with what is joined to it; a run of one script of Japanese; a word of another script; a symbol.
WORD = re.compile(
    r"(?P<number>\d+[a-z]*(?:[^\w\s]{1,2}\d+[a-z]*)*)|[々㐀-䶿一-鿿]+|[ぁ-ゟ]+|[゠-ヿ]+"
    r"|(?:[^\W\d_々ぁ-ヿ㐀-䶿一-鿿][̀-ͯ]*)+|[§°%€$×№]"
)
JOINT = re.compile(r"[^\w\s]{1,2}")


def repaired(text: str) -> str:
    """UTF-8 that was read as a western single-byte code, read again where all of it fits."""
    if re.search(r"[ÃÂÐÑãâ][\u0080-¿Œ-Ÿ‘-›€™]", text):
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except UnicodeError:
                pass
    return text


def normal(sentence: str) -> list[str]:
    """The terms of a sentence: words in lower case by their first letters, and for numbers the signs that join them (3:1 gives 0:0)."""
    out = []
    for m in WORD.finditer(sentence.lower()):
        if m.lastgroup:
            out += sorted({f"0{j}0" for j in JOINT.findall(m[0])})
        else:
            out.append(m[0][:STEM])
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, each as its terms between blanks, without markup and hidden characters."""
    if not text:
        return []
    text = HIDDEN.sub("", MARKUP.sub(" ", html.unescape(repaired(text))))
    each = (normal(unicodedata.normalize("NFKC", s)) for s in END.split(text) if s)
    return [f" {' '.join(terms)} " for terms in each if terms]


def label(value: str | None) -> int | None:
    value = (value or "").strip().lower()
    return CLASSES.index(value) if value in CLASSES else None


def language(code: str | None) -> str:
    code = re.split("[-_]", (code or "").strip().lower())[0]
    code = LANGUAGES.get(code, code)
    return code if code in SPOKEN else "xx"


def weigh(seen: np.ndarray, spoken: np.ndarray, sizes: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """For each term (row), by class: the logarithm of the odds of the class with the term, against those usual in its languages.

    seen: in how many sentences of each class a term stands; spoken: in how many of each language; sizes: how many
    sentences of each language (row) and class there are. So a word that is merely frequent in a language where a class is
    frequent says nothing. Odds of rare terms are drawn to 0, none says much against a class, and a term that many
    sentences of its languages hold counts less, by the logarithm of its rarity.
    """
    usual = (sizes + 5) / (sizes + 5).sum(1, keepdims=True)
    n = seen.sum(1, keepdims=True)
    p = spoken @ usual / n
    odds = np.clip(np.log((seen + smooth * p) / p) - np.log((n - seen + smooth * (1 - p)) / (1 - p)), -1, 4)
    among = (spoken > 0) @ sizes.sum(1)
    rarity = np.log(np.maximum(among / n[:, 0], 1.0)) / np.log(USUAL)
    return odds * np.minimum(rarity, 1.0)[:, None]


class Matcher:
    """Scores sentences by class: the weights of a sentence's different terms, added up and divided by the fourth root of how many different ones it has."""

    def __init__(self, weights: dict[str, np.ndarray]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.table = np.array(list(weights.values())).reshape(len(weights), len(CLASSES))
        for k, t in enumerate(weights):
            self.automaton.add_word(f" {t} ", k)
        self.automaton.make_automaton()

    def scores(self, told_: list[str]) -> np.ndarray:
        """A row for each sentence; 0 where it has no term."""
        out = np.zeros((len(told_), len(CLASSES)))
        if len(self.automaton):
            hits = [list({k for _, k in self.automaton.iter(s)}) for s in told_]
            size = np.array([len(h) for h in hits], np.int64)
            some = np.flatnonzero(size)
            if len(some):
                first = np.append(0, np.cumsum(size[some]))[:-1]
                length = np.array([len(set(told_[i].split())) for i in some])
                out[some] = np.add.reduceat(self.table[[k for h in hits for k in h]], first) / (length**0.25)[:, None]
        return out


def told(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, language and sentences (in normal form) of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = pa.array([language(g) for g in b["lang"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], langs, pa.array([sentences(t) for t in b["text"].to_pylist()], pa.list_(pa.string()))], ["doc_id", "language", "sentences"])

    return documents.where("doc_id IS NOT NULL").select("doc_id", "lang", F.col(text).alias("text")).mapInArrow(run, "doc_id long, language string, sentences array<string>")


class Labelled:
    """The sentences of at most EXAMPLES labelled texts, each counted twice, in five parts that can be held out by turns."""

    def __init__(self, examples: DataFrame):
        rows = examples.where("text IS NOT NULL AND subject IS NOT NULL").orderBy("example_id").limit(EXAMPLES).select("text", "lang", "subject").collect()
        found = [(s, language(r.lang), k) for r in rows if (k := label(r.subject)) is not None for s in sentences(r.text)]
        self.texts, self.spoken, self.classes = [s for s, _, _ in found], [g for _, g, _ in found], np.array([k for _, _, k in found], np.int64)
        self.part = np.array([zlib.crc32(s.encode()) % 5 for s in self.texts], np.int64)

    def counts(self, without: int | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """By term, the sentences of each class and then of each language that hold it; and the sizes that weigh() takes."""
        of, sizes = {}, np.zeros((len(SPOKEN), len(CLASSES)), np.int64)
        for s, g, k, part in zip(self.texts, self.spoken, self.classes, self.part):
            if part != without:
                sizes[SPOKEN.index(g), k] += 2
                for t in set(s.split()):
                    row = of.setdefault(t, np.zeros(len(CLASSES) + len(SPOKEN), np.int64))
                    row[k] += 2
                    row[len(CLASSES) + SPOKEN.index(g)] += 2
        return of, sizes

    def held_out(self, corpus: dict[str, np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """For each class the median score of its sentences, each weighed without its own part's labels; of those that score best for their label."""
        x = np.zeros((len(self.texts), len(CLASSES)))
        for part in range(5):
            at = np.flatnonzero(self.part == part)
            x[at] = Matcher(weights(*self.counts(part), corpus, sizes)).scores([self.texts[i] for i in at])
        best = x.argmax(1)
        own = [x[(self.classes == k) & (best == k) & (x.max(1) > 0), k] for k in range(len(CLASSES))]
        known = [float(np.median(o)) for o in own if len(o)]
        return np.array([float(np.median(o)) if len(o) else float(np.median(known)) if known else 1.0 for o in own])


def weights(labelled: dict[str, np.ndarray], labelled_sizes: np.ndarray, corpus: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The telling terms of the labelled sentences with their weights, what the corpus says about them included."""
    if not labelled:
        return {}
    n = np.array([row + corpus.get(t, 0) for t, row in labelled.items()])
    w = weigh(n[:, : len(CLASSES)], n[:, len(CLASSES) :], labelled_sizes + sizes)
    return {t: v for t, v in zip(labelled, w) if np.abs(v).max() >= TELLING}


def classed(held: DataFrame, weights_: dict[str, np.ndarray], least: np.ndarray) -> DataFrame:
    """language, sentence and class: the subject that scores best, where it scores as least has it and more than no subject; else none."""
    known = held.sparkSession.sparkContext.broadcast((weights_, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, least_ = Matcher(known.value[0]), known.value[1]
        for b in batches:
            every = b["sentences"].flatten()
            x = matcher.scores(every.to_pylist())
            best = x[:, :NONE].argmax(1)
            top = x[np.arange(len(x)), best]
            kind = np.where((top >= least_[best]) & (top > x[:, NONE]), best, NONE)
            langs = b["language"].take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(b["sentences"].offsets.to_numpy()))))
            yield pa.RecordBatch.from_arrays([langs, every, pa.array(kind.astype(np.int32))], ["language", "sentence", "class"])

    return held.select("language", F.array_distinct("sentences").alias("sentences")).mapInArrow(run, "language string, sentence string, class int")


def curate(held: DataFrame, examples: DataFrame, least: int = 3) -> tuple[DataFrame, np.ndarray]:
    """The telling terms (term, weights by class), and for each subject the score from which a sentence is given to it.

    The labelled sentences give the first terms. With these, every sentence of the corpus is put to the subject it
    scores best for, or to none, and the terms are counted by class, over all documents (a sentence once in each), and weighed again: so words
    that no labelled sentence has find their subject, wrong labels lose their weight, and words of courtesies and of
    remarks, which stand beside few terms of any subject, weigh for none. Thresholds are shares of what labelled
    sentences score that were held out.
    """
    spark = held.sparkSession
    labelled = Labelled(examples)
    own, own_sizes = labelled.counts()
    nothing = np.zeros_like(own_sizes)
    put = stage(classed(held, weights(own, own_sizes, {}, nothing), SURE * labelled.held_out({}, nothing)), "classed")
    sizes = nothing.copy()
    for r in put.groupBy("language", "class").agg(F.count("*").alias("n")).collect():  # languages x classes at most
        sizes[SPOKEN.index(r.language), r["class"]] = r.n
    each = put.select("language", "class", F.explode(F.array_distinct(F.split(F.trim("sentence"), " "))).alias("term"))
    columns = [*(F.count_if(F.col("class") == k).alias(c) for k, c in enumerate(CLASSES)), *(F.count_if(F.col("language") == g).alias(f"in_{g}") for g in SPOKEN)]
    counted = stage(each.groupBy("term").agg(*columns), "term-counts")
    fields = [*CLASSES, *(f"in_{g}" for g in SPOKEN)]
    also = spark.createDataFrame([(t, *map(int, row)) for t, row in own.items()], "term string, " + ", ".join(f"{c} long" for c in fields))
    corpus = {r.term: np.array(r[1:], np.int64) for r in counted.join(F.broadcast(also.select("term")), "term", "left_semi").select("term", *fields).collect()}  # the labelled sentences' terms
    total = counted.unionByName(also).groupBy("term").agg(*(F.sum(c).alias(c) for c in fields)).where(sum(F.col(c) for c in CLASSES) >= least)
    all_sizes = own_sizes + sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.stack([b[c].to_numpy() for c in fields], 1).reshape(b.num_rows, len(fields))
            w = weigh(n[:, : len(CLASSES)], n[:, len(CLASSES) :], all_sizes)
            keep = pa.array(np.flatnonzero(np.abs(w).max(1, initial=0) >= TELLING))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), len(CLASSES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["term"].take(keep), flat.take(keep)], ["term", "weights"])

    found = stage(total.select("term", *fields).mapInArrow(run, "term string, weights array<double>"), "terms")
    return found, GIVEN * labelled.held_out(corpus, sizes)


def matched(held: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id and scores (by class) of every sentence with a term: by an automaton that each task holds, where there are few enough terms."""
    if terms.limit(AUTOMATON + 1).count() > AUTOMATON:
        return joined(held, terms)
    known = held.sparkSession.sparkContext.broadcast({r.term: np.array(r.weights) for r in terms.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known.value)
        for b in batches:
            x = matcher.scores(b["sentences"].flatten().to_pylist())
            ids = b["doc_id"].take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(b["sentences"].offsets.to_numpy()))))
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(CLASSES)).cast(pa.list_(pa.float64()))], ["doc_id", "scores"])

    return held.select("doc_id", "sentences").mapInArrow(run, "doc_id long, scores array<double>")


def joined(held: DataFrame, terms: DataFrame) -> DataFrame:
    """matched() without an automaton: each sentence's terms meet their weights in a shuffled join, and are added up by sentence."""
    each = held.withColumn("_row", F.monotonically_increasing_id()).select("doc_id", "_row", F.posexplode("sentences").alias("_at", "_sentence"))
    words = F.array_distinct(F.split(F.trim("_sentence"), " "))
    one = each.select("doc_id", "_row", "_at", F.size(words).alias("_n"), F.explode(words).alias("term")).join(terms, "term")
    sums = one.groupBy("_row", "_at", "doc_id", "_n").agg(*(F.sum(F.get("weights", F.lit(k))).alias(f"_{k}") for k in range(len(CLASSES))))
    return sums.select("doc_id", F.array(*(F.col(f"_{k}") / F.pow(F.col("_n").cast("double"), F.lit(0.25)) for k in range(len(CLASSES)))).alias("scores"))


def subjects(documents: DataFrame, examples: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, subject and n_sentences for each subject that at least one sentence of a document is given to.

    A sentence is given to every subject for which its terms reach the threshold and score more than for none. The terms
    of all languages are in one automaton, so the labelled language of a text doesn't matter; it only balances the counts.

    Null, empty and blank texts and documents without an id give no row; repeated rows of a document add up. Markup,
    hidden characters and doubly encoded text are mended before. A text is never cut. Without labelled examples there
    are no rows.
    """
    held = stage(told(documents, text), "sentences")
    terms, least = curate(held, examples)
    score = lambda k: F.get("scores", F.lit(k))
    given = [F.when((score(k) >= F.lit(float(least[k]))) & (score(k) > score(NONE)), F.lit(s)) for k, s in enumerate(SUBJECTS)]
    each = matched(held, terms).select("doc_id", F.explode(F.array_compact(F.array(*given))).alias("subject"))
    return each.groupBy("doc_id", "subject").agg(F.count("*").alias("n_sentences"))


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """subject, n_docs, n_sentences and share (of all documents with an id) for each subject, and n_docs of 'none': those without one."""
    every = documents.where("doc_id IS NOT NULL").select("doc_id").distinct()
    per = every.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("n_sentences"))
    return per.select("subject", "n_docs", "n_sentences", (F.col("n_docs") / F.lit(every.count())).alias("share"))
