"""URL filters: gradient-boosted trees on lexical features, trained from labelled URLs."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, slices

#: Labelled URLs used for training at most; trees, their depth, and the share of each that is added.
TRAIN_ROWS, TREES, DEPTH, RATE = 4000, 60, 4, 0.2
#: URLs scored above this are rejected.
THRESHOLD = 0.5

FEATURES = [
    "length", "host_length", "depth", "longest_part", "digits", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "params", "query_length", "hyphens", "host_hyphens",
    "host_labels", "underscores", "https", "fragment", "consonant_run", "user", "suffix_score", "ending_score", "name_score", "is_ip",
]

#: Suffixes of two labels below which names are registered; elsewhere the last label is the suffix.
SUFFIXES = {f"{second}.{top}" for top, seconds in {"uk": "co org ac gov me ltd", "au": "com net org edu gov", "nz": "co org net ac govt", "jp": "co or ne ac go", "br": "com org net gov", "cn": "com org net gov", "tr": "com org gov", "in": "co org net ac gov", "kr": "co or go ac", "za": "co org ac gov", "mx": "com org gob", "ar": "com org gob", "sg": "com org edu", "hk": "com org edu", "tw": "com org edu", "il": "co org ac", "th": "co or ac", "id": "co or ac", "ua": "com org gov", "pl": "com org gov"}.items() for second in seconds.split()}

_GOOD = "news daily science museum library school university garden travel weather music history recipe cooking health children books research journal times post herald review city town county state park river mountain design studio architecture photo gallery wiki docs learn academy college institute society forum community market store coffee tea bakery hotel sport football tennis chess math physics chemistry biology nature animals birds ocean space energy water orchard bank insurance law court radio film theatre dance art poetry language grammar dictionary maps transit rail flight airport harbor bridge home house kitchen family parents baby toys fashion shoes jewelry repair tools cars bikes miller johnson schmidt garcia dubois tanaka rossi novak larsen murphy kowalski software systems consulting engineering partners medical dental clinic legal labs foundation".split()
_BAD = "poker slots jackpot bonus loans payday cash viagra xxx porn sex cams dating click banner popup lottery gambling roulette miracle diet weightloss replica rolex crypto profit easy money fast rich pharma meds discount rx hot singles escort torrent crack keygen warez hack prize winner gift verify account update secure login wallet unlock instant guaranteed deals outlet coupon clicker traffic survey sweepstakes".split()
_SLUG = "how why new best guide story about team contact annual report meeting notes local people open summer winter city plans first second photos review lesson index archive issue volume".split()


def labelled_urls(n: int = TRAIN_ROWS, seed: int = 3) -> list[tuple[str, int]]:
    """A labelled table to begin with: made-up URLs of ordinary sites (0), and of gambling, adult, fake pharmacy, phishing and advertising sites (1).

    It is made of general vocabulary, not of any table of pages. Where labelled URLs are at hand, pass those to :func:`score_urls`.
    """
    r = random.Random(seed)
    pick = r.choice

    def text(n: int, of: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> str:
        return "".join(pick(of) for _ in range(n))

    def slug() -> str:
        return pick(["-", "-", "_", ""]).join(r.choices(_SLUG + _GOOD, k=r.randint(1, 4)))

    def path(odd: bool) -> str:
        parts = [pick([slug(), slug(), str(r.randint(1, 99999)), f"{r.randint(1998, 2024)}", pick("abcdefgh") + str(r.randint(1, 99)), text(r.randint(6, 30)) if odd or r.random() < 0.1 else slug()]) for _ in range(r.randint(0, 5))]
        out = "/" + "/".join(parts) + (pick(["", "", "", ".htm", ".php", ".aspx", ".pdf"]) if parts else "")
        names = r.sample(["q", "id", "lang", "s", "item", "sort", "v", "aff", "cid", "clickid", "sub1", "token", "redirect"], r.choice([0, 0, 0, 1, 1, 2, 3]) + (r.randint(0, 4) if odd else 0))
        out += ("?" + "&".join(f"{k}={pick([str(r.randint(1, 999)), slug(), text(r.randint(8, 32)) if odd else 'en'])}" for k in names)) if names else ""
        return out + (f"#{slug()}" if r.random() < 0.1 else "")

    rows = []
    for _ in range(n):
        bad = r.random() < 0.4
        if bad:
            a, b = r.sample(_BAD, 2)
            c = pick(_GOOD)
            kind = r.random()
            name = pick([f"{a}-{b}", f"{a}-{b}", f"{a}{b}", f"{a}-{c}-{b}", f"{c}-{a}", f"{a}{r.randint(10, 9999)}", f"{a}-{b}{r.randint(1, 999)}", f"{b}-{r.randint(1, 99)}", f"{c}{a}"])
            if kind < 0.12:
                name = text(r.randint(9, 20))
            host = name + "." + pick("com com net org info biz top xyz click loan icu online site vip bid ru cc".split())
            if kind > 0.9:
                host = ".".join(r.choices(_BAD + _GOOD, k=r.randint(2, 4))) + "." + host
            elif kind > 0.86:
                host = ".".join(str(r.randint(1, 254)) for _ in range(4))
        else:
            host = "".join(r.sample(_GOOD, pick([1, 2, 2, 3]))) if r.random() < 0.85 else "-".join(r.sample(_GOOD, 2))
            host = pick(["", "", "www.", "www.", "en.", "shop.", "mail."]) + host + "." + pick("com com com org org net de fr co.uk com.au edu gov info io ca nl it es co.jp".split())
        odd = r.random() < (0.45 if bad else 0.08)
        rows.append((pick(["http://", "https://"] if bad else ["http://", "https://", "https://", ""]) + host + path(odd), int(bad)))
    return rows


_URL = r"(?s)^(?:(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]*):)?//(?P<authority>[^/?#]*)(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?$"
_PARTS = re.compile(r"[-_.0-9]+")
_CONSONANT, _IN_PATH = (bytes(chr(i) in "bcdfghjklmnpqrstvwxz" for i in range(256)), bytes(i not in b"/\0" for i in range(256)))


def parts_of(urls: pa.Array) -> dict[str, pa.Array]:
    """``scheme``, ``user`` (or nothing), ``host``, ``path``, ``query`` and ``fragment`` of each URL. Any text has them: a malformed one is taken as far as its marks go, over its whole length."""
    urls = pc.utf8_trim_whitespace(urls)
    there = pc.match_substring_regex(urls, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")
    parts = pc.extract_regex(pc.if_else(there, urls, pc.binary_join_element_wise(pa.scalar("//"), urls, "")), _URL)
    out = {name: pc.struct_field(parts, name) for name in ("scheme", "path", "query", "fragment")}
    authority = pc.struct_field(parts, "authority")
    out["user"] = pc.if_else(pc.match_substring(authority, "@"), authority, "")
    out["host"] = pc.utf8_lower(pc.replace_substring_regex(pc.replace_substring_regex(authority, r"(?s)^.*@", ""), r":[0-9]*$", ""))
    return out


def names_of(host: str) -> tuple[str, list[str]]:
    """The suffix of a host, of one label or two, and the words of its name: letters between hyphens, dots and digits."""
    labels = [x for x in host.split(".") if x]
    if len(labels) > 1 and labels[0] in ("www", "m"):
        labels = labels[1:]
    cut = 2 if ".".join(labels[-2:]) in SUFFIXES else 1
    return ".".join(labels[-cut:]), [x for label in labels[:-cut] for x in _PARTS.split(label) if x]


class Statistics:
    """How often labelled URLs with a suffix, an ending of a name's word, or a word in the name are unwanted, as smoothed log odds."""

    def __init__(self, rows: list[tuple[str, int]], weight: float = 4.0) -> None:
        counts: dict[tuple[str, str], list[int]] = {}
        base = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        hosts = parts_of(pa.array([u for u, _ in rows], pa.string()))["host"].to_pylist()
        for host, (_, y) in zip(hosts, rows, strict=True):
            for key in self.keys(host):
                c = counts.setdefault(key, [0, 0])
                c[0] += 1
                c[1] += y
        prior = np.log(base / (1 - base))
        self.odds = {k: float(np.log((s + weight * base) / (n - s + weight * (1 - base))) - prior) for k, (n, s) in counts.items() if n > 1}

    @staticmethod
    def keys(host: str) -> set[tuple[str, str]]:
        suffix, names = names_of(host)
        return {("suffix", suffix)} | {("name", x) for x in names} | {("ending", x[-4:]) for x in names}

    def scores(self, host: str) -> tuple[float, float, float]:
        """For suffix, endings and names: the log odds that are farthest from 0, the higher of two as far."""
        got: dict[str, list[float]] = {"suffix": [0.0], "ending": [0.0], "name": [0.0]}
        for key in self.keys(host):
            got[key[0]].append(self.odds.get(key, 0.0))
        return tuple(max(v, key=lambda x: (abs(x), x)) for v in got.values())  # type: ignore[return-value]


def _bytes_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes, with a zero after each text, and where each text ends."""
    raw = [t.replace("\0", " ").encode("utf-8", "replace") for t in texts.to_pylist()]
    return b"\0".join([*raw, b""]), np.cumsum([len(t) + 1 for t in raw], dtype=np.int64) - 1


def entropies(texts: pa.Array) -> np.ndarray:
    """Bits a byte of each text, from the counts of its own bytes."""
    raw, ends = _bytes_of(texts)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([-1], ends))))
    counts = np.bincount(owner * 256 + np.frombuffer(raw, np.uint8), minlength=256 * len(ends)).reshape(-1, 256).astype(float)
    counts[:, 0] = 0
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def longest_runs(texts: pa.Array, inside: bytes) -> np.ndarray:
    """Bytes of the longest run of bytes that are ``inside``, in each text."""
    raw, ends = _bytes_of(texts)
    edge = np.frombuffer(b"\0" + raw.translate(inside) + b"\0", np.uint8)
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    out = np.zeros(len(ends), np.int64)
    np.maximum.at(out, np.searchsorted(ends, turns[::2]), turns[1::2] - turns[::2])
    return out


def features_of(urls: pa.Array, stats: Statistics) -> np.ndarray:
    """One row of ``FEATURES`` for each URL (no nulls)."""
    p = parts_of(urls)
    host, path, query = p["host"], p["path"], p["query"]
    size = lambda texts: pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    count = lambda texts, what: pc.count_substring_regex(texts, what).to_numpy(zero_copy_only=False).astype(float)
    known = host.dictionary_encode()
    scores = np.array([stats.scores(h) for h in known.dictionary.to_pylist()]).reshape(-1, 3)[known.indices.to_numpy()]
    digits, host_digits = count(urls, "[0-9]"), count(host, "[0-9]")
    columns = [
        size(urls), size(host), count(path, "[^/]+"), longest_runs(path, _IN_PATH), digits, digits / np.maximum(1, size(urls)), host_digits / np.maximum(1, size(host)), entropies(urls), entropies(host),
        count(query, "[^&]+"), size(query), count(urls, "-"), count(host, "-"), count(host, "[^.]+"), count(urls, "_"), pc.equal(pc.utf8_lower(p["scheme"]), "https"), size(p["fragment"]) > 0,
        longest_runs(host, _CONSONANT), size(p["user"]) > 0, *scores.T, pc.match_substring_regex(host, r"^[0-9.]+$"),
    ]
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)


def best_split(binned: np.ndarray, cuts: list[int], grad: np.ndarray, hess: np.ndarray, least: float = 1.0) -> tuple[int, int] | None:
    """The feature and the last bin on the left of the split with the largest gain, from running sums over each feature's bins; of equal gains the first. None without a gain. ``cuts``: how many bins less one each feature has."""
    g, h = grad.sum(), hess.sum()
    best, choice = 1e-6, None
    for f, n in enumerate(cuts):
        if not n:
            continue
        gl = np.cumsum(np.bincount(binned[:, f], grad, n + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], hess, n + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(hl < least) | (h - hl < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = gain[k], (f, k)
    return choice


class Boosted:
    """Gradient-boosted regression trees for the logistic loss; splits are sought over quantiles of each feature."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = 48) -> None:
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, limit, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), np.int64)
            for at in range(size):
                rows = np.flatnonzero(node == at)
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = self.rate * g / (h + 1.0)
                if at >= 2**self.depth - 1 or len(rows) < 20:
                    continue
                if choice := best_split(binned[rows], [len(c) for c in cuts], grad[rows], hess[rows]):
                    f, k = choice
                    feature[at], limit[at] = f, cuts[f][k]
                    node[rows] = 2 * at + 1 + (binned[rows, f] > k)
            self.trees.append((feature, limit, value))
            total += self._leaf(x, self.trees[-1])
        return self

    def _leaf(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, limit, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            on = f >= 0
            at = np.where(on, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > limit[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self._leaf(x, tree)
        return 1 / (1 + np.exp(-total))


def trained(rows: list[tuple[str, int]]) -> tuple[Statistics, Boosted]:
    """Statistics and trees from labelled URLs. Each half's statistics come from the other half, lest the trees trust them too much."""
    if not rows:
        raise ValueError("no labelled URLs")
    half = len(rows) // 2
    x, y = [], []
    for a, b in ((rows[:half], rows[half:]), (rows[half:], rows[:half])):
        if b:
            x.append(features_of(pa.array([u for u, _ in b], pa.string()), Statistics(a)))
            y.append(np.array([v for _, v in b], float))
    return Statistics(rows), Boosted().fit(np.concatenate(x), np.concatenate(y))


@lru_cache(1)
def model() -> tuple[Statistics, Boosted]:
    """Trained from :func:`labelled_urls`, once in each process."""
    return trained(labelled_urls())


def score_urls(pages: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id``, ``url``, ``score`` (probability that the URL is unwanted, to 6 places) and ``keep`` for each row.

    Trees are trained from ``labelled`` (``url``, and ``label``: 1 for unwanted, 0 for others), or :func:`labelled_urls`;
    of more than ``train_rows`` labelled rows those with the least hashes of their URLs are taken. Rows without URL or label
    are passed over; with none left it is an error. Features: lengths, depth, digit ratios, entropies, counts of
    parameters, hyphens and labels, and statistics of suffixes, words and endings of the name among the labelled URLs.

    Scores depend on the URL alone: ties and repeated rows get equal ones. Null, empty and blank URLs have a null score and
    are kept. Malformed and very long URLs are scored over their whole length. An empty table gives no rows. Other columns
    don't matter, whatever their names.
    """
    need(pages, "page_id", "url")
    if labelled is None:
        stats, trees = model()
    else:
        need(labelled, "url", "label")
        known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label"))
        sample = known.orderBy(F.xxhash64("url"), "url", "label").limit(train_rows)
        stats, trees = trained([(r["url"], int(r["label"] > 0)) for r in sample.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "url"):
            urls = batch.column(1)
            there = pc.greater(pc.fill_null(pc.utf8_length(pc.utf8_trim_whitespace(urls)), 0), 0)
            at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            scores = np.full(len(urls), np.nan)
            if len(at):
                scores[at] = np.round(trees.predict(features_of(urls.take(pa.array(at)), stats)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), urls, pa.array(scores, mask=np.isnan(scores)), pa.array(~(scores > threshold))], names=["page_id", "url", "score", "keep"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, url string, score double, keep boolean")
