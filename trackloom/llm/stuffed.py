"""Keyword-stuffed pages, link lists and tag lists, by the perplexity of word-class sequences.

Every token becomes a class: the kinds of function words, content words by case and by whether their sentence or
list had them already, words of scripts without spaces, numbers, links, tags and punctuation.  A
trigram model of these classes is counted over the prose sentences of the whole corpus, and one per language that backs
off to it.  A sentence or list is abnormal if its mean surprise lies more than ``ABNORMAL`` standard errors above or
below that of its language's prose.  A page is stuffed if more than half of its characters lie in abnormal sentences or
lists that repeat their own key words, are mostly links, or string tags without the function words of prose.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.cut import cut

_TOKEN = re.compile(r"https?://\S+|www\.\S+|</?[A-Za-z][^<>]*>|\]\([^()\s]+\)|#\w+|[぀-ゟ]+|[゠-ヿ]+|[㐀-鿿가-힯]{1,2}|[^\W_぀-ヿ㐀-鿿가-힯]+(?:['’\-][^\W_぀-ヿ㐀-鿿가-힯]+)*|\n[^\S\n]*\n\s*|[^\w\s]|\n|_+")
#: Closed word classes of some languages, without accents.
FUNCTION = {
    "det": "the a an this that these those its their our your his her my each every any some no all both such another "
    "der die das den dem des ein eine einen einem einer eines kein keine jeder jede dieser diese dieses mein sein ihr unser "
    "le la les l un une des du au aux ce cet cette ces mon ma mes son sa ses leur leurs notre nos chaque tout toute tous "
    "el los las una unos unas al del este esta estos estas ese esa su sus mi mis cada todo toda todos il lo gli i uno dei della delle o os as um uma do da dos das",
    "prep": "of in on at to from by with for as over under before after between through against near without along around within during since than into onto about across behind beyond until toward per off above below "
    "von zu zum zur im am an auf aus bei mit nach vor fur gegen ohne durch uber unter um seit zwischen wahrend "
    "de dans sur sous pour par avec sans chez entre vers depuis pendant avant apres contre en a "
    "por para con sin desde hasta entre sobre tras cerca durante segun di da nel con per tra em no na com sem",
    "conj": "and or but so because when if while unless although whereas nor yet that which whose who whom what where why how whether "
    "und oder aber denn sondern weil wenn dass ob als wie obwohl et ou mais donc car ni que qui quoi dont quand si comme puis "
    "y e o u pero sino porque cuando aunque quien como donde che ma perche se quando mas porque",
    "pron": "i you he she it we they them us me him her one nobody somebody everyone anyone nothing something there "
    "ich du er sie es wir ihr mich mir dich ihn ihm uns euch man sich je tu il elle on nous vous ils elles se lui y moi "
    "yo tu usted nosotros ellos ellas me te nos io noi voi loro eu ele ela eles",
    "aux": "is are was were be been being am has have had having do does did will would can could may might must shall should not "
    "ist sind war waren wird werden wurde hat haben hatte kann konnen soll muss nicht est sont etait a ont avait sera ne pas peut fait "
    "es son era fue ha han habia sera puede no hay e sono ha non foi sao nao",
    "adv": "only just still again here now then more most less very too also even never always often ever rarely late soon long not once "
    "nur noch schon auch sehr mehr immer wieder dann hier da neu so plus tres aussi encore deja toujours bien ici seulement mas muy tambien ya siempre aqui luego",
}
_NAMES = ["edge", *FUNCTION, "kana", "lower", "lower2", "upper", "upper2", "caps", "caps2", "cjk", "cjk2", "number", "link", "tag", "long", "end", "comma", "colon", "bar", "quote", "mark", "line", "para"]
CLASS = {n: i for i, n in enumerate(_NAMES)}
#: Classes that glue a sentence together.
GLUE = [*FUNCTION, "kana"]
K = len(_NAMES)
_KIND = {w: k for k, v in FUNCTION.items() for w in v.split()}
_CONTENT = {CLASS["lower"], CLASS["upper"], CLASS["caps"], CLASS["cjk"]}
#: A content word counts as repeated if its sentence or list had it at most this many tokens before.
WINDOW = 250
#: Standard errors from the mean surprise of prose that make a sentence abnormal.
ABNORMAL = 3.0
#: Paragraphs of at most so many tokens without an end follow each other in one list.
SHORT = 15
#: Prose trigrams a language needs for a model of its own.
ENOUGH = 10_000
#: Words a list needs, and longest usual tag.
LIST, LONG = 8, 13


def token_class(t: str) -> int:
    c = t[0]
    if c == "\n":
        return CLASS["para"] if t.count("\n") > 1 else CLASS["line"]
    if t.startswith(("http", "www.")) and ("/" in t or t.startswith("www.")) or t.startswith("]("):
        return CLASS["link"]
    if c == "<":
        return CLASS["link"] if "href" in t or t.lower().startswith("</a") else CLASS["mark"]
    if c == "#" and len(t) > 1:
        return CLASS["tag"]
    if c.isalnum():
        if ord(c) > 0x2E7F:
            return CLASS["kana"] if c < "\u30a0" else CLASS["cjk"]
        if sum(x.isdigit() for x in t) * 2 >= len(t):
            return CLASS["number"]
        kind = _KIND.get(plain(t))
        if kind:
            return CLASS[kind]
        if len(t) > LONG and "-" not in t:
            return CLASS["long"]
        return CLASS["caps"] if t.isupper() and len(t) > 1 else CLASS["upper"] if c.isupper() else CLASS["lower"]
    if c in ".!?。！？":
        return CLASS["end"]
    return CLASS["comma"] if c in ",、" else CLASS["colon"] if c in ":;" else CLASS["quote"] if c in "\"'“”‘’«»()[]{}" else CLASS["bar"] if c in "|/·★•–—-*>_~" else CLASS["mark"]


def plain(t: str) -> str:
    t = t.lower()
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


class Lexicon:
    """Token strings as numbers, with class, word and length of each; emptied when full."""

    def __init__(self, most: int = 500_000):
        self.most, self.ids = most, {}
        self.kind: list[int] = []
        self.word: list[int] = []
        self.size: list[int] = []
        self.words: dict[str, int] = {}

    def __call__(self, text: str) -> list[int]:
        ids, out = self.ids, []
        for t in _TOKEN.findall(text):
            i = ids.get(t)
            if i is None:
                i = ids[t] = len(self.kind)
                self.kind.append(token_class(t))
                self.word.append(self.words.setdefault(plain(t), len(self.words)))
                self.size.append(len(t.strip()))
            out.append(i)
        return out

    def full(self) -> bool:
        return len(self.ids) > self.most


@dataclass
class Pages:
    """Tokens of many pages: class, sentence and page of each, and the sentences' pages."""

    kind: np.ndarray
    size: np.ndarray
    sentence: np.ndarray
    page: np.ndarray
    of: np.ndarray
    variety: np.ndarray  # different function words of each sentence
    count: int


def read(texts: list[str | None], lexicon: Lexicon) -> Pages:
    rows = [lexicon(t) if t else [] for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    ids = np.fromiter((i for r in rows for i in r), np.int64, int(lengths.sum()))
    kind = np.array(lexicon.kind, np.int16)[ids] if len(ids) else np.zeros(0, np.int16)
    word = np.array(lexicon.word, np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
    size = np.array(lexicon.size, np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(rows)), lengths)
    n = len(ids)
    if not n:
        return Pages(kind, size, np.zeros(0, np.int64), page, np.zeros(0, np.int64), np.zeros(0, np.int64), len(rows))
    after = np.append(kind[1:], CLASS["para"])
    # a full stop inside a number, after an initial or after the number of a line does not end a sentence
    short = np.append(False, (size[:-1] == 1) & (kind[:-1] == CLASS["upper"]))
    starts = np.append(True, (page[1:] != page[:-1]) | (kind[:-1] == CLASS["line"]) | (kind[:-1] == CLASS["para"]))
    short[1:] |= starts[:-1] & (kind[:-1] == CLASS["number"])
    stop = (kind == CLASS["end"]) & ~short & ~((after == CLASS["number"]) & (np.append(kind[:1], kind[:-1]) == CLASS["number"]))
    last = stop | (kind == CLASS["para"])
    fresh = np.append(True, last[:-1] | (page[1:] != page[:-1]))
    sentence = np.cumsum(fresh) - 1
    # short paragraphs without an end go on in one list
    open_ = (np.bincount(sentence) <= SHORT) & (np.bincount(sentence, stop) == 0)
    begin = np.flatnonzero(fresh)
    goes_on = np.append(False, open_[1:] & open_[:-1] & (page[begin][1:] == page[begin][:-1]))
    fresh[begin[goes_on]] = False
    sentence = np.cumsum(fresh) - 1
    of, words = page[fresh], int(word.max()) + 1
    # repeated content words
    content = np.flatnonzero(np.isin(kind, list(_CONTENT)))
    if len(content):
        key = sentence[content] * words + word[content]
        order = np.argsort(key, kind="stable")
        same = np.append(False, key[order][1:] == key[order][:-1])
        gap = np.append(0, np.diff(content[order]))
        again = content[order[same & (gap <= WINDOW)]]
        kind = kind.copy()
        kind[again] += 1
    glue = np.flatnonzero((kind >= 1) & (kind <= len(GLUE)))
    pairs = np.unique(sentence[glue] * words + word[glue]) // words
    variety = np.bincount(pairs, minlength=len(of))
    return Pages(kind, size, sentence, page, of, variety, len(rows))


def trigrams(p: Pages) -> np.ndarray:
    """Code of each token's trigram; a sentence starts with two edges."""
    k = p.kind.astype(np.int64)
    one, two = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    s = p.sentence
    if len(k) > 1:
        one[1:] = np.where(s[1:] == s[:-1], k[:-1], 0)
    if len(k) > 2:
        two[2:] = np.where(s[2:] == s[:-2], k[:-2], 0)
    return (two * K + one) * K + k


@dataclass
class Sentences:
    chars: np.ndarray
    words: np.ndarray
    content: np.ndarray
    again: np.ndarray
    function: np.ndarray
    numbers: np.ndarray
    links: np.ndarray
    link_chars: np.ndarray
    tags: np.ndarray
    cjk: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    variety: np.ndarray


def measure(p: Pages) -> Sentences:
    n = len(p.of)
    count = lambda *names: np.bincount(p.sentence, np.isin(p.kind, [CLASS[x] for x in names]), minlength=n)
    again, content = count("lower2", "upper2", "caps2", "cjk2"), count("lower", "lower2", "upper", "upper2", "caps", "caps2", "cjk", "cjk2")
    function, tags, cjk, numbers = count(*GLUE), count("tag", "long"), count("cjk", "cjk2"), count("number")
    link = p.kind == CLASS["link"]
    return Sentences(
        np.bincount(p.sentence, p.size + (p.size > 0) * (p.kind < CLASS["end"]), minlength=n), content + function + tags + numbers, content, again, function, numbers,
        np.bincount(p.sentence, link, minlength=n), np.bincount(p.sentence, link * (p.size + 1), minlength=n), tags, cjk, count("end"), count("lower", "lower2"), p.variety)


def prose(s: Sentences) -> np.ndarray:
    """Sentences safe enough to learn prose from."""
    w = np.maximum(s.words, 1)
    return (s.words >= 5) & (s.ends > 0) & (s.function >= 0.12 * w) & (s.again <= 0.25 * np.maximum(s.content, 1)) & (s.links == 0) & (s.tags <= 0.1 * w)


def stuffed(s: Sentences) -> np.ndarray:
    """Sentences and lists made of repeated key words, links or tags."""
    w, c = np.maximum(s.words, 1), np.maximum(s.content, 1)
    links = (s.links >= 2) & (s.link_chars >= 0.3 * s.chars)
    figures = s.numbers > 0.4 * w
    keys = (s.content >= 6) & (s.again >= 0.45 * c) & ~figures
    tags = (s.tags >= 3) & (s.tags >= 0.5 * w)
    # a list names things in lower case or as tags, without the mixed function words of a sentence and without its end
    bare = (s.words >= LIST) & (s.ends == 0) & (s.variety <= 1 + s.words // 20) & (s.low + s.tags >= 0.3 * (s.content + s.tags)) & ~figures & (s.cjk <= 0.3 * w)
    return links | keys | tags | bare


def readable(raw: bytes | None) -> str | None:
    return raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") if raw else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class trigrams of the prose sentences by language."""
    totals, lexicon = {}, Lexicon()
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            if lexicon.full():
                lexicon = Lexicon()
            part = batch.slice(a, 500)
            p = read([readable(t) for t in part.column("text").to_pylist()], lexicon)
            if not len(p.kind):
                continue
            langs, which = np.unique(np.array(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            good = prose(measure(p))[p.sentence]
            code, lang = trigrams(p)[good], which[p.page[good]]
            for i, name in enumerate(langs):
                if name not in totals and len(totals) >= 100:
                    yield from _batches(totals)
                    totals = {}
                totals[name] = totals.get(name, 0) + np.bincount(code[lang == i], minlength=K**3)
    yield from _batches(totals)


def _batches(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(at)), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["lang", "code", "n"])


@dataclass
class Model:
    """Surprise of every trigram by language, with its mean and variance over that language's prose; row 0 serves all other languages."""

    langs: dict[str, int]
    surprise: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def abnormal(self, z: np.ndarray) -> np.ndarray:
        return np.abs(z) > ABNORMAL

    @staticmethod
    def of(total: np.ndarray, by_lang: dict[str, np.ndarray] | None = None, k: float = 3.0) -> Model:
        def smooth(c3: np.ndarray, back: np.ndarray | None) -> np.ndarray:
            c3 = c3.reshape(K, K, K)
            if back is None:
                c2, c1 = c3.sum(0), c3.sum((0, 1))
                p1 = (c1 + 1) / (c1.sum() + K)
                back = (c2 + k * p1) / (c2.sum(1, keepdims=True) + k)
            return (c3 + k * back) / (c3.sum(2, keepdims=True) + k)

        every = smooth(total, None)
        names = sorted(by_lang or {})
        p = [every, *(smooth(by_lang[x], every) for x in names)]
        s = np.stack([-np.log(x).ravel() for x in p])
        c = np.stack([total, *(by_lang[x] for x in names)])
        n = np.maximum(c.sum(1), 1)
        mean = (c * s).sum(1) / n
        variance = (c * (s - mean[:, None]) ** 2).sum(1) / n
        return Model({x: i + 1 for i, x in enumerate(names)}, s.astype(np.float32), mean, np.where(variance > 0, variance, 1.0))


def train(docs: DataFrame) -> Model:
    """Class trigrams of all prose sentences; at most K^3 counts reach the driver, and as many of each language with ENOUGH of them."""
    counts = cut(docs.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    total, by_lang = np.zeros(K**3), {}
    for r in counts.groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["code"]] = r["n"]
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= ENOUGH).toLocalIterator():
        by_lang[r["lang"]] = np.zeros(K**3)
    for r in counts.where(F.col("lang").isin(list(by_lang))).toLocalIterator():
        by_lang[r["lang"]][r["code"]] = r["n"]
    return Model.of(total, by_lang)


_KINDS = "doc_id long, surprise double, z double, share double"


def judge(texts: list[bytes | None], langs: list[str], model: Model, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean surprise, its distance from the language's prose in standard errors, and the share of stuffed characters of each page."""
    p = read([readable(t) for t in texts], lexicon)
    lang = np.array([model.langs.get(x, 0) for x in langs], np.int64)
    each = model.surprise[lang[p.page], trigrams(p)] if len(p.kind) else np.zeros(0)

    def mean_and_z(group: np.ndarray, count: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(group, minlength=count)
        mean = np.bincount(group, each, minlength=count) / np.maximum(n, 1)
        return mean, np.where(n > 0, (mean - model.mean[own]) / np.sqrt(model.variance[own] / np.maximum(n, 1)), 0)

    mean, z = mean_and_z(p.page, p.count, lang)
    s = measure(p)
    bad = model.abnormal(mean_and_z(p.sentence, len(p.of), lang[p.of])[1]) & stuffed(s)
    chars = np.bincount(p.of, s.chars, minlength=p.count)
    share = np.bincount(p.of, s.chars * bad, minlength=p.count) / np.maximum(chars, 1)
    return mean, z, share


def _judge(model: Model, every: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("surprise", pa.float64()), ("z", pa.float64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                if lexicon.full():
                    lexicon = Lexicon()
                part = batch.slice(a, 500)
                mean, z, share = judge(part.column("text").to_pylist(), part.column("lang").to_pylist(), model, lexicon)
                keep = np.flatnonzero(every | (share > 0.5))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep)), pa.array(mean[keep]), pa.array(z[keep]), pa.array(share[keep])], schema=schema)

    return run


def stuffed_pages(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = None, every: bool = False) -> DataFrame:
    """(doc_id, surprise, z, share) of the stuffed pages, or of every page.

    Null, empty and blank texts are never stuffed.  Rows without doc_id are ignored, repeated rows are judged each and
    come out once.  Whole texts are read; all of them train the model.  ``lang`` names the column of the language, if there
    is one; its case does not matter, and pages without it, or in a language with little prose, are held against all prose.
    """
    known = F.coalesce(F.lower(F.trim(F.col(lang).cast("string"))), F.lit("")) if lang else F.lit("")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), known.alias("lang")).where("doc_id is not null")
    model = train(docs.where("text is not null"))
    return docs.mapInArrow(_judge(model, every), _KINDS).distinct()
