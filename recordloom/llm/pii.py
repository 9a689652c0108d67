"""Personal data by a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, slices

LABELS = ["O", "EMAIL", "PHONE", "IP", "CARD", "KEY", "SECRET", "ID", "IBAN"]
#: Labels whose values may have several words, and the digits that one value has at most.
JOINED = {"PHONE": 15, "CARD": 19, "IBAN": 34}
#: Sentences of the labelled table that are used for training, at most.
TRAIN_ROWS = 2000
#: A word with any of these characters, or some others, is a signal word. A word with none within REACH words is quiet: the model gives it no
#: label but "O", in training and in decoding, if the labelled table has no other there. Features look REACH words to either
#: side, so with CONTEXT words around each signal word all is decoded as in the whole text.
SIGNAL, REACH = "0123456789@=+", 2
CONTEXT = 2 * REACH
#: What may stand around a word and isn't part of it.
AROUND = ".,;:!?\"'()[]<>#$%&*"
#: As AROUND, but for brackets that a telephone number may begin with.
EDGES = AROUND.replace("(", "").replace(")", "")
#: The score of a label that can't be.
NEVER = -1e6
#: Words, with padding, that are decoded at once.
BATCH_WORDS = 50_000

_WORD = re.compile(r"\S+")
_SIGNAL_IN = re.compile("[" + re.escape(SIGNAL) + "]|AKIA|ASIA|::")
_ONWARD = re.compile(r"\S*(?:\s+\S+){0,%d}" % CONTEXT)
_RUNS = re.compile(r"[A-Z]+|[^\W\d_A-Z]+|\d+|[^\w]|_")
_KEYWORDS = {"token", "password", "secret", "key", "api_key", "apikey", "passwd", "pwd", "=", ":", "tel", "phone", "call", "card", "ip", "host", "mail", "email", "ssn", "iban", "account"}


def shape(word: str) -> str:
    """The word with runs of capitals, other letters and digits as ``A``, ``a`` and ``9``."""
    return "".join("A" if "A" <= x[0] <= "Z" else "9" if x[0].isdigit() else "a" if x[0].isalpha() else x for x in _RUNS.findall(word))


def measured(word: str) -> str:
    """The shape with the length of each run of digits."""
    return "".join(f"9{{{len(x)}}}" if x[0].isdigit() else "A" if "A" <= x[0] <= "Z" else "a" if x[0].isalpha() else x for x in _RUNS.findall(word))


def checksum(digits: str) -> bool:
    """Whether the last digit is the check digit of the others, as on cards (each second digit doubled, from the right)."""
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0


def own_features(word: str) -> tuple[str, ...]:
    """Features of one word, in time linear in its length: its shapes, lengths, counts by class of character, checks of its digits."""
    return _kept_features(word) if len(word) <= 64 else _features(word)


def _features(word: str) -> tuple[str, ...]:
    bare = word.strip(AROUND)
    sh = shape(bare[:64])
    low = bare.lower() if len(bare) < 16 else ""
    named = (f"kw={low}",) if low in _KEYWORDS or word in ("=", ":") else ()
    if not _SIGNAL_IN.search(word):
        return ("plain", f"plain={sh if len(sh) < 3 else 'other'}", *named)
    size, runs = len(bare), measured(bare[:64])
    numbers = re.findall("[0-9]+", bare)
    digits, upper, lower = sum(map(len, numbers)), sum("A" <= c <= "Z" for c in bare), sum("a" <= c <= "z" for c in bare)
    before, equals, value = bare.partition("=")
    value = value.strip("\"'")
    _, at, domain = bare.rpartition("@")
    out = [
        *named,
        f"shape={sh if len(sh) < 14 else 'long'}",
        f"runs={runs if len(runs) < 40 else 'long'}",
        f"open={word[:1] if word[:1] in '(+' else word.strip(EDGES)[:1] if word.strip(EDGES)[:1] in '(+' else ''}",
        f"size={min(size, 40) // 3}",
        f"digits={min(digits, 20)}",
        f"only={('9' if digits else '') + ('A' if upper else '') + ('a' if lower else '') if digits + upper + lower == size else 'other'}{min(size, 34) if size >= 12 else ''}",
    ]
    if at:
        out.append(f"at={bare.count('@')}{domain.count('.') > 0}{domain.rpartition('.')[2].isalpha()}{size > len(domain) + 1}")
    if equals:
        out += [f"set={before.lower() if before.lower() in _KEYWORDS else 'other'}", f"value={min(len(value), 24) // 4}{any(c.isdigit() for c in value)}"]
    if upper >= 4:
        out.append(f"prefix={bare[:4] if bare[:4] in ('AKIA', 'ASIA') else 'other'}")
    if len(numbers) == 4 and bare.count(".") == 3 and digits + 3 == size:
        out.append(f"octets={all(len(x) < 4 and int(x) < 256 for x in numbers)}")
    if bare.count(":") > 1 and size < 46:
        out.append(f"groups={all(len(x) < 5 and all(c in '0123456789abcdefABCDEF' for c in x) for x in bare.split(':'))}{'::' in bare or bare.count(':') == 7}")
    plain = bare.replace("-", "")
    if 13 <= digits <= 19 and len(plain) == digits:
        out.append(f"check={checksum(plain)}")
    if size >= 16 and digits + lower == size and lower and all(c in "0123456789abcdef" for c in bare):
        out.append(f"hex={word[:1] in '\"' + chr(39)}")
    if 4 <= size <= 34 and bare[:2].isupper() and bare[2:4].isdigit() and bare.isalnum():
        out.append(f"country={min(size, 16)}")
    return tuple(out)


_kept_features = lru_cache(100_000)(_features)
_TOLD = ("kw=", "runs=9", "runs=+", "runs=(", "open=(", "open=+", "country=")


def features(words: list[str], i: int) -> list[str]:
    """Features of word ``i``: its own, and numbers, signs and key words up to ``REACH`` words away."""
    own = [*own_features(words[i]), "bias"]
    for d in range(-REACH, REACH + 1):
        if d and 0 <= i + d < len(words):
            own += [f"{d}:{f}" for f in own_features(words[i + d]) if f.startswith(_TOLD)]
    return own


def quiet_words(words: list[str]) -> np.ndarray:
    """Which words have no signal word within ``REACH``, nor are one."""
    signal = np.array([bool(_SIGNAL_IN.search(w)) for w in words], dtype=float)
    return np.convolve(signal, np.ones(2 * REACH + 1))[REACH : REACH + len(words)] == 0


class CRF:
    """Weights of features by label, and of label pairs. quiet: quiet words are "O"."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray, quiet: bool) -> None:
        self.index, self.emit, self.step, self.quiet = index, emit, step, quiet

    def scores(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores, padded to the longest sentence, and lengths."""
        n = np.array([len(s) for s in sentences])
        out = np.zeros((len(sentences), int(n.max(initial=1)), len(LABELS)))
        for a, s in enumerate(sentences):
            silent = quiet_words(s) if self.quiet else np.zeros(len(s), bool)
            out[a, : len(s), 1:][silent] = NEVER
            for i in np.flatnonzero(~silent):
                at = [self.index[f] for f in features(s, i) if f in self.index]
                out[a, i] = self.emit[at].sum(axis=0)
        return out, n

    def decode(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sentence: Viterbi over all of them at once; of equally good ones the first."""
        if not sentences:
            return []
        emit, n = self.scores(sentences)
        batch, length, k = emit.shape
        best, back = emit[:, 0], np.zeros((length, batch, k), np.int8)
        for i in range(1, length):
            ways = best[:, :, None] + self.step[None]
            back[i] = ways.argmax(axis=1)
            best = np.where((i < n)[:, None], ways.max(axis=1) + emit[:, i], best)
        at = best.argmax(axis=1)
        out = np.zeros((length, batch), np.int8)
        for i in range(length - 1, -1, -1):
            out[i] = at
            at = np.where(i < n, back[i][np.arange(batch), at], at) if i else at
        return [out[: n[a], a] for a in range(batch)]


def labelled() -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sentences made of invented words with personal data and look-alikes, word by word."""
    r = random.Random(7)
    letters, hexes, caps = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    syllables = ["ba", "ker", "lo", "mi", "dra", "sto", "vel", "pon", "gri", "fu", "schn", "ung", "heit", "ção", "é", "eau", "ción", "os", "ñ", "ü", "tz", "qui"]
    pick = r.choice

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(r.randint(1, 5)))
        w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.02 else f"{w}-{pick(syllables)}" if r.random() < 0.02 else w
        return w + pick([""] * 8 + [",", ".", ";", ":"])

    def text(n: int, of: str = letters) -> str:
        return "".join(pick(of) for _ in range(n))

    def num(n: int) -> str:
        return text(n, "0123456789")

    def card(good: bool, n: int = 16) -> str:
        digits = pick("3456") + num(n - 2)
        last = next(x for x in "0123456789" if checksum(digits + x))
        return digits + (last if good else pick([x for x in "0123456789" if x != last]))

    def fours(digits: str, mark: str) -> str:
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def iban() -> str:
        return text(2, caps) + num(2) + pick(["", text(4, caps)]) + num(pick([14, 16, 18]))

    top = lambda: pick(["com", "org", "net", "de", "fr", "co.uk", "es", "io"])
    code = lambda: text(20, "0123456789" + caps)
    make = {
        "EMAIL": [lambda: f"{text(r.randint(2, 10))}{pick(['', '.', '_', '-', '+'])}{pick([num(r.randint(0, 3)), text(3)])}@{text(r.randint(3, 8))}{pick(['', '', num(1)])}{pick(['', '.' + text(4)])}.{top()}"],
        "PHONE": [
            lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{r.randint(1, 99)} {num(3)} {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}",
            lambda: f"0{num(2)} {num(4)} {num(4)}", lambda: f"+{r.randint(10, 99)} {num(2)} {num(4)} {num(4)}", lambda: f"0{num(4)} {num(6)}", lambda: f"+{r.randint(1, 99)}{num(9)}", lambda: f"+{r.randint(10, 99)} {num(3)} {num(7)}", lambda: f"+{r.randint(1, 99)}-{num(3)}-{num(3)}-{num(4)}",
        ],
        "IP": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))] * 2 + [lambda: ":".join([text(r.randint(1, 4), hexes) for _ in range(7)] + [num(2)]), lambda: ":".join(text(r.randint(1, 4), hexes) for _ in range(r.randint(1, 4))) + "::" + text(r.randint(1, 4), hexes)],
        "CARD": [lambda: card(True), lambda: card(True), lambda: fours(card(True), " "), lambda: fours(card(True), "-"), lambda: card(True, 15)],
        "KEY": [lambda: "AKIA" + text(16, caps + "234567"), lambda: "ASIA" + text(16, caps + "234567")],
        "SECRET": [lambda: f"{pick(['password', 'passwd', 'pwd', 'secret'])}={text(r.randint(8, 24), pick([hexes, letters + '0123456789']))}{num(1)}", lambda: f'{pick(["token", "api_key", "secret"])} = "{text(pick([32, 40, 40, 64]), hexes)}"', lambda: f"{pick(['token', 'api_key'])}={text(pick([32, 40]), hexes)}"],
        "ID": [lambda: f"{num(3)}-{num(2)}-{num(4)}"],
        "IBAN": [iban, lambda: fours(iban(), " ")],
    }
    ordinary = [
        lambda: str(r.randint(1, 2100)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}{pick(['', '.'])}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(2)}.{num(2)}.{num(4)}",
        lambda: f"${num(2)}.{num(2)}", lambda: f"{num(2)}%", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"x={num(1)}", lambda: f"a={text(3)}", lambda: f"#{num(3)}", lambda: f"{text(4)}###", lambda: f"{text(5)}%%%", lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: f"{text(6)}***", lambda: f"{text(4)}&&&", lambda: f"{text(5)}$$$", lambda: "password", lambda: "token", lambda: "secret", lambda: "= 3", lambda: "and/or", lambda: f"COVID{num(2)}", lambda: text(3).upper() + num(1), lambda: card(False), lambda: card(False), lambda: fours(card(False), "-"),
        lambda: f"version {r.randint(1, 9)}.", lambda: f"@{text(6)}", lambda: f"{num(3)}-{num(1)}", lambda: f"v{num(1)}.{num(1)}", lambda: f"({num(4)})", lambda: num(pick([5, 6, 7, 8, 9, 10, 12, 13, 14])), lambda: f"+{num(1)}", lambda: "Version 2.0.", lambda: "BY-NC 4.0.", lambda: f"http://{text(5)}.com/{text(4)}?{text(2)}={num(2)}",
        lambda: text(6) + num(1), lambda: "_" + text(4) + "_", lambda: f"[{num(1)}]", lambda: "ISO-" + num(4), lambda: "A" + num(1), lambda: f"{num(4)}-{num(4)}", lambda: f"{num(3)}.{r.randint(256, 999)}.{num(3)}.{num(2)}", lambda: text(pick([7, 12, 16, 32, 40]), hexes), lambda: code(), lambda: f"{text(2, caps)}-{num(4)}-{num(4)}",
        lambda: f"{num(4)} {num(4)}", lambda: " ".join(num(pick([1, 2, 3])) for _ in range(r.randint(2, 6))), lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"x = {num(3)}", lambda: f"{text(3)}::{text(4)}{num(1)}", lambda: f"1 + {num(1)} = {num(1)}", lambda: f"{text(4)}@{text(5)}",
    ]
    rows = []
    for _ in range(2600):
        words, tags = [], []
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(0, 6)):
                words.append(word())
                tags.append(0)
            if r.random() < 0.58:
                kind = pick(LABELS[1:])
                new = pick(make[kind])().split(" ")
                for k, w in enumerate(new):
                    named = kind == "SECRET" and len(new) == 3 and k < 2  # only the value is secret
                    last = k == len(new) - 1
                    words.append(w + (pick([",", ".", ";", "###", "***", "!!", "&&&"]) if last and r.random() < 0.25 else ""))
                    tags.append(0 if named else LABELS.index(kind))
            else:
                new = pick(ordinary)().split(" ")
                words += new
                tags += [0] * len(new)
        if words:
            rows.append((words, tags))
    return rows


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 80, l2: float = 1e-4) -> CRF:
    """Maximum likelihood by full-batch gradients (forward and backward over all sentences at once) with Adam, from the first ``TRAIN_ROWS`` sentences."""
    rows = sorted(((words, tags) for words, tags in rows[:TRAIN_ROWS] if words), key=lambda row: -len(row[0]))
    if not rows:
        raise ValueError("no labelled sentences")
    k = len(LABELS)
    index: dict[str, int] = {}
    slot, feat = [], []
    n = np.array([len(w) for w, _ in rows])
    batch, length = len(rows), int(n.max())
    silent = np.zeros((batch, length), bool)
    for a, (words, _) in enumerate(rows):
        silent[a, : len(words)] = quiet_words(words)
    quiet = not any(tag for a, (_, tags) in enumerate(rows) for tag, still in zip(tags, silent[a], strict=False) if still)
    silent &= quiet
    for a, (words, _) in enumerate(rows):
        for i in np.flatnonzero(~silent[a, : len(words)]):
            for f in features(words, i):
                slot.append(a * length + i)
                feat.append(index.setdefault(f, len(index)))
    slot_, feat_ = np.array(slot), np.array(feat)
    heads = np.flatnonzero(np.concatenate(([True], slot_[1:] != slot_[:-1])))  # slots rise: sums by slot and, sorted, by feature are sums of stretches
    by_feature = np.argsort(feat_, kind="stable")
    ends = np.searchsorted(feat_[by_feature], np.arange(len(index)))
    gold = np.zeros((batch, length), np.int64)
    for a, (_, tags) in enumerate(rows):
        gold[a, : len(tags)] = tags
    mask = np.arange(length)[None] < n[:, None]
    emit, step = np.zeros((len(index), k)), np.zeros((k, k))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    gold_one = np.eye(k)[gold] * mask[..., None]
    gold_step = np.zeros((k, k))
    inner = mask[:, 1:]
    np.add.at(gold_step, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)

    longer = mask.sum(axis=0)  # the longest sentences come first: so many have a word at a place
    for t in range(1, rounds + 1):
        flat = np.zeros((batch * length, k))
        flat[slot_[heads]] = np.add.reduceat(emit[feat_], heads, axis=0)
        e = flat.reshape(batch, length, k)
        e[silent, 1:] = NEVER
        # Forward and backward chances, put to a sum of one at each place: the scales cancel in what is summed below.
        own, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(step - step.max())
        alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((batch, length, 1))
        for i in range(length):
            m = longer[i]
            now = own[:m, i] if i == 0 else alpha[:m, i - 1] @ move * own[:m, i]
            scale[:m, i] = now.sum(axis=1, keepdims=True)
            alpha[:m, i] = now / scale[:m, i]
        pair = np.zeros((k, k))
        for i in range(length - 1, 0, -1):
            m = longer[i]
            ahead = own[:m, i] * beta[:m, i] / scale[:m, i]
            beta[:m, i - 1] = ahead @ move.T
            pair += move * (alpha[:m, i - 1].T @ ahead)
        p = alpha * beta * mask[..., None]
        grad_emit = np.add.reduceat((gold_one - p).reshape(-1, k)[slot_[by_feature]], ends, axis=0)
        grads = [grad_emit / batch - l2 * emit, (gold_step - pair) / batch - l2 * step]
        for j, (weights, g) in enumerate(zip((emit, step), grads, strict=True)):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights += 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return CRF(index, emit, step, quiet)


@lru_cache(1)
def model() -> CRF:
    """The model trained from :func:`labelled`, once in each process."""
    return train(labelled())


def spans_of(texts: list[str | None], crf: CRF, whole: bool = False) -> list[tuple[int, int, int, str, str]]:
    """(number of the text, start, stop, kind, value) of each piece of personal data. Where the model is quiet, words away from any signal word are passed over, unless ``whole``."""
    where: list[tuple[int, list[tuple[int, int]]]] = []
    sentences = []
    for t, text in enumerate(texts):
        if not text:
            continue
        for a, b in _windows(text) if crf.quiet and not whole else [(0, len(text))]:
            places = [m.span() for m in _WORD.finditer(text, a, b)]
            if places:
                where.append((t, places))
                sentences.append([text[x:y] for x, y in places])
    out = []
    order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
    while order:  # sentences of like lengths together, so many that their padded words stay within bounds
        longest = len(sentences[order[-1]])
        ids = order[-max(1, BATCH_WORDS // longest) :]
        del order[-len(ids) :]
        for i, tags in zip(ids, crf.decode([sentences[i] for i in ids]), strict=True):
            out += _values(texts[where[i][0]], where[i], sentences[i], tags)
    return sorted(out)


def _values(text: str, where: tuple[int, list[tuple[int, int]]], words: list[str], tags: np.ndarray) -> Iterator[tuple[int, int, int, str, str]]:
    """The values of one sentence: labelled words, and of ``JOINED`` kinds those beside each other, until another begins."""
    t, places = where
    k = 0
    while k < len(words):
        if not tags[k]:
            k += 1
            continue
        kind, end = LABELS[tags[k]], k + 1
        digits = sum(c.isdigit() for c in words[k])
        while kind in JOINED and end < len(words) and tags[end] == tags[k]:
            digits += sum(c.isdigit() for c in words[end])
            if digits > JOINED[kind] or words[end].startswith("+") or any(f.startswith("country=1") for f in own_features(words[end])):
                break
            end += 1
        found = text[places[k][0] : places[end - 1][1]]
        lead, bare = len(found) - len(found.lstrip(EDGES)), found.strip(EDGES)
        if kind != "PHONE":
            lead, bare = len(found) - len(found.lstrip(AROUND)), found.strip(AROUND)
        yield t, places[k][0] + lead, places[k][0] + lead + len(bare), kind, bare
        k = end


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches of whole words that hold every signal word with ``CONTEXT`` words on either side."""
    out: list[tuple[int, int]] = []
    done = 0  # the end of the last signal word
    for m in _SIGNAL_IN.finditer(text):
        if m.start() < done:
            continue
        a, floor = m.start(), out[-1][1] if out else 0
        for k in range(CONTEXT + 1):
            while a > floor and not text[a - 1].isspace():
                a -= 1
            if k == CONTEXT or a <= floor:
                break
            while a > floor and text[a - 1].isspace():
                a -= 1
        done, b = _END.match(text, m.end()).end(), _ONWARD.match(text, m.end()).end()
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_END = re.compile(r"\S*")


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``start`` and ``stop`` (in characters), ``kind`` and ``value`` of each piece of personal data or secret.

    A conditional random field labels the words of a text from their shapes and neighbours. It is trained from ``labelled``
    (``words`` and ``tags``, arrays of strings of one length; tags are of ``LABELS``, any other counts as "O"), or from
    the small table that the function :func:`labelled` makes; of more than ``TRAIN_ROWS`` sentences those with the least
    hashes are taken. Kinds: EMAIL, PHONE, IP, CARD, KEY (access keys), SECRET (passwords, tokens), ID (numbers of social
    security), IBAN. Quotes and punctuation around a value are not part of it.

    Null, empty and blank texts give no rows. Very long texts and words are decoded whole, in linear time. Of equally good
    labels (a tie) the first of ``LABELS`` counts. Rows without ``doc_id`` are decoded too and give a null id. Repeated
    rows give repeated results. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    need(docs, "doc_id", "text")
    if labelled is None:
        crf = model()
    else:
        need(labelled, "words", "tags")
        known = labelled.where("words IS NOT NULL AND tags IS NOT NULL AND size(words) = size(tags)").select("words", "tags")
        sample = known.orderBy(F.xxhash64("words", "tags"), F.to_json(F.struct("words", "tags"))).limit(TRAIN_ROWS)
        number = {name: k for k, name in enumerate(LABELS)}
        crf = train([([w or "-" for w in r["words"]], [number.get(t, 0) for t in r["tags"]]) for r in sample.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = spans_of(batch.column(1).to_pylist(), crf)
            t, start, stop, kind, value = zip(*got, strict=True) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(t, pa.int64())), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(kind, pa.string()), pa.array(value, pa.string())],
                names=["doc_id", "start", "stop", "kind", "value"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, start int, stop int, kind string, value string")
