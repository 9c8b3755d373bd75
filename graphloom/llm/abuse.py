"""Abusive, hateful or sexual content (problem 9).

Texts are cut into passages; a passage is a sparse set of hashed words, word pairs and triples (pairs and triples of characters in Chinese and the
like), read through common disguises: foreign look-alike letters, digits and signs for letters, repeated, spaced, dotted or starred
letters, invisible characters. A cumulative-link model gives each passage the probability of each severity grade, with one weight
vector shared by all thresholds; a document has the expected severity of its worst passage.

Labels say only that some passage of a document is abusive, and some are mistaken. Fitting therefore alternates: the worst passage of a positive
document is taken as its example, all passages of the others as neutral ones; after the first rounds documents whose label the model
contradicts clearly are set aside.

Scale: the model is fitted in one task on at most FIT_DOCUMENTS labelled documents, chosen by a hash of their ids; its weights have a fixed size. Scoring is
one narrow pass over all documents; what a worker remembers of passages is bounded.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from graphloom.session import spread

#: The most labelled documents the model is fitted on.
FIT_DOCUMENTS = 12_000
BITS = 18
ROUNDS = 5
STEPS = 120
FOLDS = 4
POSITIVE_WEIGHT = 4.0
#: Passages with fewer features than this (four words) weigh as if they had so many.
SHORT = 9
CACHE_PASSAGES = 100_000
CACHE_WORDS = 200_000
#: Documents of a batch whose passages are scored in one step.
SCORED_TOGETHER = 500
THRESHOLD = 0.2
#: Severity of the categories reviewers name; abusive without a known category counts as the first grade.
GRADES = {"insult": 1, "sexual": 2, "hate": 3}
TOP = 3

# Letters that look like Latin ones, and signs written for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһꞵνοαρτικηυςєԛԝɡıɑ", "aeopcyxijsdhbvoaptiknuceqwgia")
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "€": "e", "£": "l", "+": "t"})
_BREAK = re.compile(r"(?<=[.!?…])[\s\"')\]]+|[\n\r\u2028\u2029]+|(?<=[。！？；])|(?<=\s)/s(?=\s)|[\U0001F300-\U0001FAFF]+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}]|[^\P{Cc}\n\t\r]")
_DOTTED = re.compile(r"(?:[^\W\d_][.\-·]){2,}[^\W\d_]\W*")
_PIECES = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_REPEAT = re.compile(r"(.)\1+")
_EMPHASIS = re.compile(r"[_~*]*([^\W_]+(?:/[^\W\d_]+)*)[_~]*")
_EDGES = ".,;:?!()[]{}<>\"'’“”…|#>*"
_FORMS: dict[str, tuple[str, ...]] = {}
_INNER: dict[str, tuple[str, ...]] = {}
IDENTIFIER = ("idf",)
_CODES: dict[str, int] = {}
MASK = (1 << BITS) - 1


def plain(text: str) -> str:
    """Lower case without invisible characters, accents and look-alike letters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", _HIDDEN.sub("", unicodedata.normalize("NFKD", text))).lower().translate(LOOKALIKES)


def forms(token: str) -> tuple[str, ...]:
    """The words of a token with disguises undone: signs for letters read as letters, runs of a letter as one; *w* for a word with starred letters."""
    known = _FORMS.get(token)
    if known is None:
        known = _read(token)
        if len(_FORMS) > CACHE_WORDS:
            _FORMS.clear()
        if len(token) < 40:
            _FORMS[token] = known
    return known


def _read(token: str) -> tuple[str, ...]:
    if _CJK.search(token):
        return tuple(c for part in re.split(r"([\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])", token) if part for c in ((part,) if _CJK.match(part) else forms(part)))
    if token[0] == "@" and len(token) > 2 and not ("$" in token or "!" in token[1:-3]) and (len(token) > 8 or "-" in token or "_" in token):
        return ("@m",)
    bare = token.strip(_EDGES)
    if not bare:
        return ()
    if "_" in bare or "~" in bare:
        marked = _EMPHASIS.fullmatch(bare)  # _word_ and ~~word~~ are marked words, a_b is an identifier
        bare = marked.group(1) if marked else bare
    if "/" in bare and len(bare) <= 40 and all(word.isalpha() for word in bare.split("/")):
        return tuple(w for word in bare.split("/") for w in forms(word))
    if len(bare) > 40 or "_" in bare or "`" in bare or "::" in bare or "/" in bare or "@" in bare[1:-1] and "." in bare:
        return IDENTIFIER
    if "*" in bare:
        return ("*w*",)
    if _DOTTED.fullmatch(bare):
        bare = re.sub(r"[.\-·]", "", bare)
    if any(c.isdigit() or c in "$@!€£+" for c in bare):
        read = token.strip(".,;:?()[]{}<>\"'’“”…|#>*").translate(SIGNS)
        letters = sum(c.isalpha() for c in bare)
        if letters == 0 and "$" not in bare and "@" not in bare:
            return ("9",)
        if letters * 2 >= len(bare) or "$" in bare or "@" in bare:
            # a final ! is a mark, not a letter
            bare = (token.strip(_EDGES) if token.rstrip("!") != token else token.strip(".,;:?()[]{}<>\"'’“”…|#>*")).translate(SIGNS) if letters else read
        elif any(c.isdigit() for c in bare):
            return ("9",)
    return tuple(_REPEAT.sub(r"\1", w.replace("'", "").replace("’", "")) for w in _PIECES.findall(bare))


def inner(token: str) -> tuple[str, ...]:
    """The words within an identifier, path or other long token."""
    known = _INNER.get(token)
    if known is None:
        known = tuple(w for piece in re.findall(r"[^\W\d_]{2,}", token) for w in ((piece,) if len(piece) > 40 else forms(piece)))
        if len(_INNER) > CACHE_WORDS:
            _INNER.clear()
        if len(token) < 80:
            _INNER[token] = known
    return known


def words_of(part: str) -> list[tuple[str, ...]]:
    """The word forms of a passage, and of each identifier in it as a passage of its own."""
    out: list[tuple[str, ...]] = []
    words: list[str] = []
    single = ""
    for token in part.split():
        bare = token.strip(_EDGES) or token
        if len(bare) == 1 and (bare.isalpha() or bare in "$@013457") and not _CJK.match(bare):
            single += bare
            continue
        if single:
            words += forms(single) if len(single) > 2 else list(single)
            single = ""
        read = forms(token)
        words += read
        if read == IDENTIFIER and (held := inner(token)):
            out.append(held)
    if single:
        words += forms(single) if len(single) > 2 else list(single)
    if words:
        out.insert(0, tuple(words))
    return out


def parts(text: str) -> list[str]:
    return [p for p in _BREAK.split(plain(text)) if p]


def passages(text: str) -> list[tuple[str, ...]]:
    """The word forms of each passage of a text."""
    return [words for part in parts(text) for words in words_of(part)]


def windows(words: tuple[str, ...], size: int = 14) -> list[tuple[str, ...]]:
    """Long passages in overlapping windows, so that what stands anywhere in them counts alike."""
    if len(words) <= size + 4:
        return [words]
    return [words[i : i + size] for i in range(0, len(words) - size // 2, size // 2)]


def features_of(passages_: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code): the hashed words, pairs and triples of words of each of many passages, each once a passage, in order of owners."""
    if len(_CODES) > CACHE_WORDS:
        _CODES.clear()
    flat = [w for words in passages_ for w in words]
    for w in set(flat).difference(_CODES):
        _CODES[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    one = np.array([_CODES[w] for w in flat], np.uint64)
    owner = np.repeat(np.arange(len(passages_)), [len(words) for words in passages_])
    two = one[:-1] * np.uint64(1_000_003) + one[1:]
    three = two[:-1] * np.uint64(1_000_003) + one[2:]
    in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    every = np.concatenate([one, two[in_two], three[in_three]])
    code = (every ^ (every >> np.uint64(17))) & np.uint64(MASK)
    key = np.unique(np.concatenate([owner, owner[:-1][in_two], owner[:-2][in_three]]).astype(np.int64) << BITS | code.astype(np.int64))
    return key >> BITS, (key & MASK).astype(np.int32)


def features(words: tuple[str, ...]) -> np.ndarray:
    """Hashed words, pairs and triples of words, each once."""
    return features_of([words])[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """P(grade >= k) = sigmoid(w.x - cut_k) with x of unit length (less for very short passages): one weight vector for ordered cuts."""

    def __init__(self, weights: np.ndarray | None = None, cuts: np.ndarray | None = None):
        self.weights = np.zeros(1 << BITS, np.float32) if weights is None else weights
        self.cuts = np.arange(1, TOP + 1, dtype=np.float64) if cuts is None else cuts

    def levels(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= TOP) of each score."""
        return _sigmoid(score[:, None] - self.cuts[None, :])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        lengths = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        sums = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return sums / np.sqrt(np.maximum(lengths, SHORT))

    def scores_of(self, passages_: list[tuple[str, ...]]) -> np.ndarray:
        """The score of each passage's worst window."""
        if not passages_:
            return np.empty(0)
        cut_up = [windows(words) for words in passages_]
        owner, code = features_of([w for ws in cut_up for w in ws])
        n = sum(map(len, cut_up))
        score = np.bincount(owner, self.weights[code], n) / np.sqrt(np.maximum(np.bincount(owner, minlength=n), SHORT))
        return np.maximum.reduceat(score, np.concatenate([[0], np.cumsum([len(ws) for ws in cut_up])[:-1]]))

    def fit(self, rows: list[np.ndarray], grades: np.ndarray, importance: np.ndarray, steps: int = STEPS, rate: float = 0.5, ridge: float = 2e-4) -> None:
        """Maximises the cumulative-link likelihood by AdaGrad over all rows."""
        lengths = np.array([len(r) for r in rows])
        used, flat = np.unique(np.concatenate(rows), return_inverse=True)  # only weights of features that occur change
        weights = self.weights[used]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(rows)), lengths)
        scale = 1 / np.sqrt(np.maximum(lengths, SHORT))
        total = importance.sum()
        seen_w, seen_c = np.full(len(used), 1e-8), np.full(TOP, 1e-8)
        n = np.arange(len(rows))
        for _ in range(steps):
            score = np.add.reduceat(weights[flat], starts) * scale
            reach = np.concatenate([np.ones((len(rows), 1)), self.levels(score), np.zeros((len(rows), 1))], axis=1)
            p = np.maximum(reach[n, grades] - reach[n, grades + 1], 1e-9)
            slope = reach * (1 - reach)
            upper, lower = slope[n, grades] / p, slope[n, grades + 1] / p
            g = -(upper - lower) * importance / total
            grad = np.bincount(flat, weights=(g * scale)[owner], minlength=len(used)) + ridge / len(rows) * weights
            seen_w += grad**2
            weights = (weights - rate * grad / np.sqrt(seen_w)).astype(np.float32)
            cut_grad = np.zeros(TOP)
            np.add.at(cut_grad, grades[grades > 0] - 1, (upper * importance)[grades > 0] / total)
            np.add.at(cut_grad, grades[grades < TOP], -(lower * importance)[grades < TOP] / total)
            seen_c += cut_grad**2
            self.cuts = np.maximum.accumulate(self.cuts - 0.1 * cut_grad / np.sqrt(seen_c))
            self.cuts = self.cuts + np.arange(TOP) * 1e-3 * (np.diff(self.cuts, prepend=self.cuts[0] - 1) <= 0)
        self.weights = self.weights.copy()
        self.weights[used] = weights


def fit(texts: list[str], grades: list[int], rounds: int = ROUNDS) -> Ordinal:
    """The model of labelled texts; with no positive or no negative texts, one that finds nothing."""
    known: dict[tuple, int] = {}
    rows: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    for t in texts:
        mine = set()
        for words in passages(t):
            for w in windows(words):
                mine.add(known.setdefault(w, len(known)))
        docs.append(np.array(sorted(mine), np.int64))
    if known:
        owner, code = features_of(list(known))
        rows = np.split(code, np.flatnonzero(np.diff(owner)) + 1)
    grade = np.array(grades, np.int64)
    positive = [i for i in range(len(docs)) if grade[i] > 0 and len(docs[i])]
    negative = [i for i in range(len(docs)) if grade[i] == 0 and len(docs[i])]
    model = Ordinal()
    model.cuts = model.cuts + 3
    if not positive or not negative:
        return Ordinal(cuts=np.full(TOP, 30.0) + np.arange(TOP))
    # to begin with, all passages of positive documents, weighed by how rare they are among the neutral ones
    count = np.zeros((2, 1 << BITS))
    for side, group in ((1, positive), (0, negative)):
        for i in group:
            count[side][np.unique(np.concatenate([rows[k] for k in docs[i]]))] += 1
    rate = np.log((count[1] + 0.1) / (len(positive) + 0.2)) - np.log((count[0] + 0.5) / (len(negative) + 1.0))
    support = np.minimum(1, (count[1] + count[0]) / 3)
    model.weights = (np.where(count[1] > 1, rate, np.minimum(rate, 0)) * support).astype(np.float32)
    score = model.scores(rows)
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts])
    aside: set[int] = set()
    for turn in range(rounds):
        model = _fit_once(rows, docs, grade, [i for i in positive if i not in aside], [i for i in negative if i not in aside], score, count) or model
        score = model.scores(rows)
        if turn == 1:
            # what a model of the other folds says of a document, no document speaking for itself
            held = np.zeros(len(docs))
            for f in range(FOLDS):
                other = _fit_once(rows, docs, grade, [i for i in positive if fold[i] != f], [i for i in negative if fold[i] != f], score, count)
                if other is not None:
                    mine = [i for i in range(len(docs)) if fold[i] == f and len(docs[i])]
                    levels = other.levels(other.scores(rows))[:, 0]
                    held[mine] = [levels[docs[i]].max() for i in mine]
            unlike = {i for i in positive if held[i] < 0.25}
            keep = {i for i in unlike if support_of(rows, docs[i], score, count)}
            aside = {i for i in negative if held[i] > 0.75} | (unlike - keep)
        elif turn > 1:
            sure = model.levels(score)[:, 0]
            aside = {i for i in aside if grade[i] or sure[docs[i]].max() > 0.6} | {i for i in negative if sure[docs[i]].max() > 0.85}
    return model


def support_of(rows: list[np.ndarray], doc: np.ndarray, score: np.ndarray, count: np.ndarray) -> bool:
    """Whether the worst passage of a document has words in a row that positive documents share and neutral ones never have."""
    worst = rows[doc[np.argmax(score[doc])]]
    return int(((count[1][worst] >= 3) & (count[0][worst] == 0)).sum()) >= 3


def _fit_once(rows: list, docs: list, grade: np.ndarray, positive: list[int], negative: list[int], score: np.ndarray, count: np.ndarray) -> Ordinal | None:
    """A model of the worst passages of positive documents against all passages of negative ones."""
    examples: dict[int, list[int]] = {}
    for i in positive:
        worst = docs[i][np.argmax(score[docs[i]])]
        examples.setdefault(int(worst), []).append(int(grade[i]))
    neutral: dict[int, int] = {}
    for i in negative:
        for k in docs[i]:
            neutral[int(k)] = neutral.get(int(k), 0) + 1
    use, y, weight = [], [], []
    for k, gs in examples.items():
        n_pos, n_neg = len(gs), neutral.pop(k, 0)
        if n_pos > n_neg:
            use.append(k), y.append(int(np.median(gs))), weight.append(float(n_pos - n_neg) ** 0.5 * POSITIVE_WEIGHT)
        else:
            use.append(k), y.append(0), weight.append(float(n_neg - n_pos + 1) ** 0.5)
    for k, n in neutral.items():
        use.append(k), y.append(0), weight.append(min(n, 25) ** 0.5)
    if not any(y) or all(y):
        return None
    # what one positive document alone has is no evidence
    seen = (count[1] > 1) | (count[0] > 0)
    kept = [rows[k][seen[rows[k]]] if seen[rows[k]].any() else rows[k][:1] for k in use]
    model = Ordinal()
    model.cuts = model.cuts + 3
    model.fit(kept, np.array(y), np.array(weight))
    model.weights[~seen] = 0
    return model


def labels(documents: DataFrame, reviews: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, text, grade): labelled documents with text, at most so many; grade is the mean of the opinions' grades, a tie of yes and no counts as no."""
    grade = F.lit(1)
    for name, g in GRADES.items():
        grade = F.when(F.lower(F.trim("category")) == name, g).otherwise(grade)
    opinions = reviews.where("doc_id is not null and abusive is not null").select("doc_id", F.when(F.col("abusive"), grade).otherwise(0).alias("g"))
    per = opinions.groupBy("doc_id").agg(F.avg((F.col("g") > 0).cast("int")).alias("share"), F.avg(F.when(F.col("g") > 0, F.col("g"))).alias("g"))
    per = per.select("doc_id", F.when(F.col("share") > 0.5, F.round("g")).otherwise(0).cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.where("text is not null").select("doc_id", "text").join(per, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "text", "grade")


def fitted(documents: DataFrame, reviews: DataFrame, most: int = FIT_DOCUMENTS) -> bytes:
    """The weights and cuts of the model, of a fixed size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        m = fit(pdf["text"].tolist(), pdf["grade"].tolist())
        return pd.DataFrame({"model": [m.cuts.astype(np.float64).tobytes() + m.weights.astype(np.float16).tobytes()]})

    got = labels(documents, reviews, most).groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").collect()
    if got:
        return bytes(got[0]["model"])
    return (np.full(TOP, 30.0) + np.arange(TOP)).tobytes() + np.zeros(1 << BITS, np.float16).tobytes()


def scores(documents: DataFrame, reviews: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, source, severity, p_abusive): every document; severity is the expected grade of its worst passage, from 0 to TOP.

    Null, empty and wordless texts have 0. Sources compare without case, blanks and hyphens. Without labels nothing is found. An empty
    table gives no rows; repeated rows are scored each; extra columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fitted(documents, reviews, most))

    @F.pandas_udf("severity double, p_abusive double")
    def score(texts: pd.Series) -> pd.DataFrame:
        blob = shared.value
        model = Ordinal(np.frombuffer(blob[8 * TOP :], np.float16).astype(np.float32), np.frombuffer(blob[: 8 * TOP], np.float64))
        kept: dict[str, float] = {}
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(texts), SCORED_TOGETHER):
            cut_up = [parts(t) if isinstance(t, str) and t else [] for t in texts.iloc[at : at + SCORED_TOGETHER]]
            new = [p for p in {p for ps in cut_up for p in ps} if p not in kept]
            read = [words_of(p) for p in new]
            flat = model.scores_of([words for r in read for words in r])
            score, start = {}, 0
            for p, r in zip(new, read):
                score[p] = float(flat[start : start + len(r)].max()) if r else -np.inf
                start += len(r)
            for i, ps in enumerate(cut_up):
                best[at + i] = max((score[p] if p in score else kept[p] for p in ps), default=-np.inf)
            if len(kept) < CACHE_PASSAGES:
                kept |= {p: s for p, s in score.items() if len(p) < 300}
        levels = np.where(best[:, None] > -np.inf, model.levels(np.maximum(best, -1e9)), 0.0)
        return pd.DataFrame({"severity": levels.sum(axis=1), "p_abusive": levels[:, 0]})

    source = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source")
    return spread(documents.select("doc_id", source, "text")).select("doc_id", "source", score("text").alias("s")).select("doc_id", "source", F.round("s.severity", 6).alias("severity"), F.round("s.p_abusive", 6).alias("p_abusive"))


def found(documents: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id): documents whose worst passage is abusive with at least this probability."""
    return scores(documents, reviews, most).where(F.col("p_abusive") >= threshold).select("doc_id")


def rates(documents: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_severity) of each source."""
    bad = (F.col("p_abusive") >= threshold).cast("int")
    by = scores(documents, reviews).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(bad).alias("n_abusive"), F.round(F.avg("severity"), 6).alias("mean_severity"))
    return by.select("source", "n_documents", "n_abusive", F.round(F.col("n_abusive") / F.col("n_documents"), 6).alias("rate"), "mean_severity")
