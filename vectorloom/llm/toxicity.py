"""Scores for abusive, hateful or sexually explicit language by a classifier chain.

A text is cut into lines, for one bad line makes a document bad. Each line is a bag of hashed runs of one to three words, where words
are first reduced to skeletons that survive look-alike letters, digits for letters, stretched, spaced, masked or misread letters,
lost accents and invisible characters. A link of the chain is a linear model of lines; a document's probability is that of its highest
line, which also stands for the document's label while the models are fitted.

The links predict one after the other, the probabilities of earlier ones being features of the later; while fitting, those come from models
that haven't seen the document: neither its weights nor the choice of features knew its label (out of fold). The first link is the verdict from words
alone, and tells which lines make a document bad; then come the categories; the last link is the verdict of the raters again. Each link's bias is
set so that 0.5 is the operating point of its out-of-fold scores, so no threshold is chosen by hand.

Raters label documents toxic or not, never the category. A category's label is weak: a document that raters call toxic and that has,
in a line that the first link (out of fold) holds for bad, a word that begins with one of the category's seeds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.ids import plain_name

BITS = 20
#: At most so many labelled documents, those of the smallest hash, are fitted on the driver.
MAX_LABELLED = 9_000
FOLDS, EPOCHS, L2, THRESHOLD = 5, 20, 0.05, 0.5
#: Their texts are at most so many bytes together.
MAX_BYTES = 64 << 20
#: How many false alarms weigh as one miss while the operating point is chosen: a sample of labelled documents is richer in toxic ones than the corpus.
FALSE_ALARM = 3.0
#: Lines to which the first link gives less belong to no category.
GATE = 0.02
#: Words to which masked ones may be completed.
LEXICON = 6_000
#: The share of the features' log odds with which the weights begin, and to which they are drawn.
HEAD_START = 0.8

#: Seed words of the categories, in the languages of the corpus, as beginnings of words.
SEEDS = {
    "sexual": "naked nipple tits cock pussy panties fucked moaned desnud bragas penetr nackt nippel schwanz seins culotte bite calcinha cuecas трусы сиськ член соск おっぱい 裸 乳首",
    "threat": "kill slit shoot strangle drown mato mueras parto umbringen tuer égorg crève morra убью сдохни прирежу 殺 死ね",
    "hate": "vermin parasite subhuman disease breed ratas plaga ratten ungeziefer untermensch vermine rats ratos praga крыс паразит 害虫 ゴミ",
    "insult": "bastard moron cunt asshole whore bitch fuck freak imbecile idiot mierda puta perra zorra cerdo arschloch schlampe fresse merde connard salope pute merda puta porco сука ублюдок мразь тварь クズ バカ",
}
CHAIN = ("words", *SEEDS, "toxic")

_INVISIBLE = re.compile("[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_SPACED = re.compile(r"\b\w(?:[ .\-]\w\b){2,}")
_MOJIBAKE = re.compile("[Â-ï][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_TAGS = re.compile(r"<[^>\n]{0,40}>|\{[^}\n]{0,40}\}|\\N")
#: A word; marks within it stand for letters, some also at its ends; a letter of a script without blanks is a word.
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[@$0-9*#_]*[^\W\d_぀-ヿ㐀-鿿](?:[^\W_぀-ヿ㐀-鿿]|[*#_@$!?�'’]+(?=[^\W_])|[*#_]+(?!\w))*")
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(r"[぀-ヿ㐀-鿿]")
#: Behind and before these a sentence may go on in the next line.
_GOES_ON, _WENT_ON = (",", "-", "–", "…", ".."), ("..", "…")
#: Longer pieces between blanks aren't remembered.
_PIECE = 24
#: Letters that stand for each other, by look, by scanners' errors or by choice: each row becomes its first letter.
_ALIKE = ("oaо0@4а", "ece3еёс", "li1!|jіїl", "tf7т", "hb8нв", "gq9", "s5$ѕ", "uvµ", "pр", "xх", "yу", "kк", "mм")
_FOLD = {ord(c): row[0] for row in _ALIKE for c in row[1:]}
_FOLD |= {ord(c): "*" for c in "#_?�"} | {ord(c): None for c in "'’"}
_VOWELS = str.maketrans("", "", "oeluyаеёиоуыэюя*")
_RUN = re.compile(r"(.)\1+")
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {chr(b): b for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def repair(text: str) -> str:
    """UTF-8 that was read as cp1252 is read again, line by line; what can't be repaired stays."""
    if not _MOJIBAKE.search(text):
        return text
    out = []
    for line in text.split("\n"):
        if _MOJIBAKE.search(line):
            try:
                line = bytes(_CP1252[c] for c in line).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                pass
        out.append(line)
    return "\n".join(out)


def fold(word: str) -> str:
    """A word in lower case without accents, look-alikes and repeats; a mask (any letter) is ``*``."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return _RUN.sub(r"\1", w.translate(_FOLD)).replace("rn", "m")


def skeleton(word: str) -> tuple[str, str]:
    """(folded word, its consonants): equal for most damaged spellings of a word."""
    w = fold(word)
    return w, w.translate(_VOWELS) or w


class _Words:
    """The words seen so far, by number: their two hashes, and how a sentence may run over the line breaks beside them.

    A text is cut at blanks first, for most pieces between them have been seen before.
    """

    #: Flags of a word: it begins in lower case or behind dots, so a sentence may go on in it; or its sentence may go on behind it.
    INTO, BEYOND = 1, 2

    def __init__(self, masked: dict[str, str]):
        self.masked = masked
        self.clear()

    def clear(self):
        self.pieces: dict[str, tuple[int, ...]] = {"": (), "\n": (0,)}
        self.number: dict[tuple[str, int], int] = {("\n", 0): 0}
        self.rows: list[tuple[int, int, int]] = [(0, 0, 0)]

    def hashes(self, word: str) -> tuple[int, int]:
        w = fold(word)
        if "*" in w:
            w = self.masked.get(w, w)
        return xxhash.xxh64_intdigest(w, 1) >> 1 or 1, xxhash.xxh64_intdigest(w.translate(_VOWELS) or w, 2) >> 1 or 1

    def complete(self, masked: dict[str, str]) -> None:
        """Masked words become those that they stand for."""
        self.masked = masked
        for (word, flag), i in self.number.items():
            if i and "*" in fold(word):
                self.rows[i] = (*self.hashes(word), flag)

    def cut(self, piece: str) -> tuple[int, ...]:
        if not _LETTER.search(piece):
            return ()
        found = _TOKEN.findall(piece)
        out = []
        for i, word in enumerate(found):
            into = word[0].islower() or (i == 0 and piece.startswith(_WENT_ON))
            key = (word, self.INTO * into + self.BEYOND * (i == len(found) - 1 and piece.endswith(_GOES_ON)))
            n = self.number.get(key)
            if n is None:
                n = self.number[key] = len(self.rows)
                self.rows.append((*self.hashes(word), key[1]))
            out.append(n)
        if len(piece) <= _PIECE:
            self.pieces[piece] = tuple(out)
        return tuple(out)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all words, a line break being 0, one text after the other; how many each text has)."""
        if len(self.rows) + len(self.pieces) > 2_000_000:
            self.clear()
        flat: list[int] = []
        size = np.zeros(len(texts), np.int64)
        known, before = self.pieces, 0
        for i, text in enumerate(texts):
            if text:
                for piece in _clean(text).split(" "):
                    flat += known[piece] if piece in known else self.cut(piece)
                flat.append(0)
                size[i] = len(flat) - before
                before = len(flat)
        return np.array(flat, np.int64), size


def _clean(text: str) -> str:
    """Without markup and invisible characters, spaced words together, each line break between blanks."""
    s = text if text.isascii() else _INVISIBLE.sub("", repair(text))
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-]", "", m[0]), _TAGS.sub(" ", s))
    s = s.replace("\r", "\n").replace("|", "\n").replace("\t", " ")
    return s.replace(" -\n", "-\n").replace(" ...\n", "...\n").replace("\n... ", "\n...").replace("\n", " \n ")


def unmasking(numbers: np.ndarray, size: np.ndarray, words: _Words) -> dict[str, str]:
    """For each folded word with one or two masked places the most frequent word that fits, of at most LEXICON words of three documents or more."""
    pair = _distinct(np.repeat(np.arange(len(size)), size) * len(words.rows) + numbers)
    df = np.bincount(pair % len(words.rows), minlength=len(words.rows))
    known: Counter = Counter()
    for (word, _), i in words.number.items():
        if i and df[i] and len(w := fold(word)) > 2 and "*" not in w:
            known[w] += int(df[i])
    out: dict[str, str] = {}
    for w, n in sorted(known.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
        if n >= 3 and len(w) <= 16:
            for i in range(len(w)):
                for j in range(i, len(w)):
                    if j == i or len(w) > 4:
                        out.setdefault(_RUN.sub(r"\1", "".join("*" if at in (i, j) else c for at, c in enumerate(w))), w)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - BITS)).astype(np.int32)


def features(numbers: np.ndarray, size: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, line of each feature, feature) of the words of some texts; lines without words have no features.

    Where a sentence may go on in the next line (a comma, dash or dots at the break, or a small letter behind it) both lines together are one more line.
    """
    if not numbers.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    h = np.fromiter(chain.from_iterable(words.rows), np.uint64, 3 * len(words.rows)).reshape(-1, 3)
    doc = np.repeat(np.arange(len(size)), size)
    keep = numbers != 0
    # words of one text between two breaks are a line
    start = np.flatnonzero(keep & np.r_[True, ~keep[:-1]])
    end = np.flatnonzero(keep & np.r_[~keep[1:], True])
    text_of = doc[start]
    flag = h[:, 2].astype(np.int8)
    on = (text_of[1:] == text_of[:-1]) & ((flag[numbers[end[:-1]]] & _Words.BEYOND > 0) | (flag[numbers[start[1:]]] & _Words.INTO > 0))
    w, k = h[:, 0][numbers[keep]], h[:, 1][numbers[keep]]
    count = end - start + 1
    first = np.cumsum(count) - count
    joined = np.flatnonzero(on)
    both = count[joined] + count[joined + 1]
    at = np.repeat(first[joined] - (np.cumsum(both) - both), both) + np.arange(int(both.sum()))
    ln = np.r_[np.repeat(np.arange(len(start)), count), np.repeat(len(start) + np.arange(len(joined)), both)]
    w, k, text_of = np.r_[w, w[at]], np.r_[k, k[at]], np.r_[text_of, text_of[joined]]
    lines, feats = [ln], [_mix(w)]
    run, run_k = w, k
    for n in range(2, 4):
        if len(w) < n:
            break
        same = ln[n - 1 :] == ln[: len(ln) - n + 1]
        run = run[:-1] * np.uint64(1_000_003) + w[n - 1 :]
        run_k = run_k[:-1] * np.uint64(998_244_353) + k[n - 1 :]
        lines += [ln[n - 1 :][same]] * 2
        feats += [_mix(run[same]), _mix(run_k[same] ^ np.uint64(0x5555))]
    return text_of, np.concatenate(lines), np.concatenate(feats)


def _sigmoid(s):
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class _Data:
    """Features of labelled documents."""

    def __init__(self, doc: np.ndarray, line: np.ndarray, feat: np.ndarray, n_docs: int):
        self.doc, self.line, self.feat, self.n_docs = doc, line, feat, n_docs
        self.by_doc = np.argsort(doc, kind="stable")
        pair = _distinct(doc[line] * (1 << BITS) + feat)
        self.pair_doc, self.pair_feat = pair >> BITS, pair % (1 << BITS)

    def kept(self, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, their log odds), chosen by the labels of the documents ``on`` alone.

        Kept are features of two documents or more that occur clearly more often in bad ones, and the other features of lines that hold a strong
        one of these, for they tell the harmless uses of a word.
        """
        here = on[self.pair_doc]
        df = np.bincount(self.pair_feat[here], minlength=1 << BITS)
        bad = np.bincount(self.pair_feat[here], y[self.pair_doc[here]], minlength=1 << BITS)
        prior = y[on].mean()
        rate = (bad + prior) / (df + 1)
        keep = (df >= 2) & (bad >= 1.2) & (rate >= 2 * prior)
        strong = keep & (rate >= 3 * prior)
        context = np.zeros(len(self.doc), bool)
        context[self.line[strong[self.feat]]] = True
        context &= on[self.doc]
        keep[self.feat[context[self.line]]] = True
        used = np.flatnonzero(keep & (df >= 2))
        rate = np.clip((bad[used] + 2 * prior) / (df[used] + 2), 1e-3, 1 - 1e-3)
        return used, np.log(rate / (1 - rate)) - np.log(prior / (1 - prior))

    def fit(self, y: np.ndarray, on: np.ndarray, extra: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all features, and of (1, extra...), of a logistic model of lines, from the labels of the documents ``on``.

        The first weights are the features' log odds. A document's highest line, found by them and again after a third of the epochs, stands
        for its label; the other lines of clean documents are negative.
        """
        full, v = np.zeros(1 << BITS, np.float32), np.zeros(1 + extra.shape[1])
        v[0] = -8.0
        if y[on].sum() < 1:
            return full, v
        used, odds = self.kept(y, on)
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        at = place[self.feat]
        real = (at >= 0) & on[self.doc][self.line]
        ln, ft = self.line[real], at[real]
        # lines of the same features and earlier probabilities (in eighths) are one; those without features are alike
        mark = np.bincount(ln, np.random.default_rng(5).random(len(used))[ft], minlength=len(self.doc))
        rows = self.by_doc[on[self.doc[self.by_doc]]]
        part = np.round(extra[rows] * 8)
        key = mark[rows] + part @ (np.pi * 1000.0 ** np.arange(1, 1 + part.shape[1]))
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        n, doc = len(first), self.doc[rows]
        x = np.column_stack([np.ones(n), part[first] / 8])
        row = np.full(len(self.doc), -1)
        row[rows[first]] = np.arange(n)
        model = row[ln] >= 0
        line, feat = row[ln[model]], ft[model]
        scale = 1 / np.sqrt(np.maximum(np.bincount(line, minlength=n), 1))
        inst = np.bincount(kind, minlength=n)
        w, v = HEAD_START * odds, np.zeros(x.shape[1])
        v[0] = -5.0
        s = np.bincount(line, odds[feat], minlength=n) * scale
        m, q = [np.zeros_like(w), np.zeros_like(v)], [np.zeros_like(w), np.zeros_like(v)]
        by_doc = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        of_doc = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
        for i in range(1, epochs + 1):
            if i in (1, 1 + epochs // 3):
                # the highest line of each document
                sk = s[kind]
                top = np.flatnonzero(sk == np.maximum.reduceat(sk, by_doc)[of_doc])
                top = top[np.r_[True, doc[top[1:]] != doc[top[:-1]]]]
                t, c = np.zeros(n), inst.astype(float)
                np.add.at(t, kind[top], y[doc[top]])
                # a bad document may have other bad lines, so its other lines say nothing
                unsure = y[doc] >= 0.5
                unsure[top] = False
                np.subtract.at(c, kind[unsure], 1)
            g = c * _sigmoid(s if i > 1 else np.bincount(line, w[feat], minlength=n) * scale + x @ v) - t
            gs = g * scale
            for k, (par, grad) in enumerate(zip((w, v), (np.bincount(feat, gs[line], minlength=len(w)) + L2 * (w - HEAD_START * odds), x.T @ g + L2 * np.r_[0, v[1:]]), strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                q[k] = 0.99 * q[k] + 0.01 * grad * grad
                par -= 0.1 * (m[k] / (1 - 0.9**i)) / (np.sqrt(q[k] / (1 - 0.99**i)) + 1e-2)
            s = np.bincount(line, w[feat], minlength=n) * scale + x @ v
        full[used] = w
        return full, v

    def scores(self, w: np.ndarray, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return line_scores(self.line, w[self.feat], len(self.doc), v, extra)

    def out_of_fold(self, y: np.ndarray, extra: np.ndarray, epochs: int, folds: int) -> np.ndarray:
        """Scores of the lines by models, their features included, that haven't seen the labels of the lines' documents."""
        fold, out = np.arange(self.n_docs) % folds, np.zeros(len(self.doc))
        for k in range(folds):
            held = fold[self.doc] == k
            out[held] = self.scores(*self.fit(y, fold != k, extra, epochs), extra)[held]
        return out

    def highest(self, scores: np.ndarray) -> np.ndarray:
        out = np.full(self.n_docs, -30.0)
        np.maximum.at(out, self.doc, scores)
        return out


def line_scores(line: np.ndarray, weight: np.ndarray, n: int, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The sum of each line's weights over the root of the number of its known features, and what the earlier links add."""
    known = np.bincount(line[weight != 0], minlength=n)
    return np.bincount(line, weight, minlength=n) / np.sqrt(np.maximum(known, 1)) + v[0] + extra @ v[1:]


def true_labels(toxic: np.ndarray, votes: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The probability that a document is toxic, given how many of its votes say so: raters' error rates and the share of toxic documents by EM."""
    share, hit, false = 0.15, 0.9, 0.05
    for _ in range(rounds if len(votes) else 0):
        a = share * hit**toxic * (1 - hit) ** (votes - toxic)
        b = (1 - share) * false**toxic * (1 - false) ** (votes - toxic)
        p = a / (a + b)
        share = np.clip(p.mean(), 0.001, 0.9)
        hit = np.clip((p * toxic).sum() / max(1e-9, (p * votes).sum()), 0.6, 0.99)
        false = np.clip(((1 - p) * toxic).sum() / max(1e-9, ((1 - p) * votes).sum()), 0.002, 0.4)
    return p if len(votes) else np.empty(0)


def _seeded(words: _Words) -> dict[str, np.ndarray]:
    """The features of each category's seeds: every word seen that begins with one, however it was damaged; in scripts without blanks the signs in a row."""
    out = {}
    folded = {f: words.rows[i][0] for (w, _), i in words.number.items() if i and (f := words.masked.get(fold(w), fold(w)))}
    for name, seeds in SEEDS.items():
        plain = tuple(fold(x) for x in seeds.split() if not _SIGN.match(x))
        found = {h for f, h in folded.items() if f.startswith(plain)}
        for x in seeds.split():
            if _SIGN.match(x):
                run = 0
                for c in x:
                    run = (run * 1_000_003 + words.hashes(c)[0]) % (1 << 64)
                found.add(run)
        out[name] = _mix(np.array(sorted(found), np.uint64))
    return out


@dataclass
class Chain:
    """The fitted links (weights by feature, (bias, weights of the earlier links' probabilities)), and what masked words stand for."""

    links: list[tuple[np.ndarray, np.ndarray]]
    masked: dict[str, str]

    def small(self) -> "Chain":
        """With the weights as (places, values), to be sent."""
        return Chain([((np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)]), v) for w, v in self.links], self.masked)

    def whole(self) -> "Chain":
        full = [np.zeros(1 << BITS, np.float32) for _ in self.links]
        for f, ((at, w), _) in zip(full, self.links, strict=True):
            f[at] = w
        return Chain([(f, v) for f, (_, v) in zip(full, self.links, strict=True)], self.masked)


def operating_point(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which a document counts: of the greatest F1 over the documents whose label is nearly sure, a false alarm counting FALSE_ALARM times.

    Sure are documents of a probability under 0.002 (mostly two raters who agree; of those called clean by one, so many are bad that they would pass for false alarms) or above 0.95.
    """
    sure = (y < 0.002) | (y > 0.95)
    s, t = scores[sure], y[sure] > 0.5
    if not t.any() or t.all():
        return 0.0  # too few to tell
    order = np.argsort(-s)
    hit, false = np.cumsum(t[order]), np.cumsum(~t[order])
    f1 = 2 * hit / (t.sum() + hit + FALSE_ALARM * false)
    f1[:-1][np.diff(s[order]) == 0] = -1
    best = int(np.argmax(f1))
    below = s[order][best + 1] if best + 1 < len(s) else s[order][best] - 1
    return float((s[order][best] + below) / 2)


def fit_chain(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, folds: int = FOLDS) -> tuple[Chain, dict]:
    """(the chain, measures of its out-of-fold predictions by link: documents of the class, precision and recall against its own labels)."""
    if not len(texts) or y.sum() < 1:
        return Chain([(np.zeros(1 << BITS, np.float32), np.r_[-8.0, np.zeros(i)]) for i in range(len(CHAIN))], {}), {}
    words = _Words({})
    numbers, size = words.of(texts)
    words.complete(unmasking(numbers, size, words))
    doc, line, feat = features(numbers, size, words)
    data = _Data(doc, line, feat, len(texts))
    everyone = np.ones(len(texts), bool)
    links, measures = [], {}

    def link(name: str, data: _Data, target: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Fit a link; the scores of its lines out of fold."""
        w, v = data.fit(target, everyone, extra, epochs)
        out = data.out_of_fold(target, extra, epochs, folds)
        top = data.highest(out)
        v[0] -= (at := operating_point(top, target))
        links.append((w, v))
        sure = (target < 0.002) | (target > 0.95)
        hit, true = top[sure] >= at, target[sure] > 0.5
        measures[name] = {"documents": int(true.sum()), "precision": float((hit & true).sum() / max(1, hit.sum())), "recall": float((hit & true).sum() / max(1, true.sum()))}
        return out - at

    out = link(CHAIN[0], data, y, np.zeros((len(doc), 0)))
    # the lines that make a document bad: all that the held-out models find, and its highest
    bad_line = (out >= 0) | ((out >= data.highest(out)[doc] - 1e-9) & (y[doc] > 0.5))
    # the categories' links see the lines that the first doesn't hold for harmless
    p = _sigmoid(out)
    gate, place = p >= GATE, np.cumsum(p >= GATE) - 1
    seen = gate[line]
    near, bad_line, seeds = _Data(doc[gate], place[line[seen]], feat[seen], len(texts)), bad_line[gate], _seeded(words)
    extra = p[gate][:, None]
    for name in SEEDS:
        seeded, has = np.zeros(len(near.doc), bool), np.zeros(len(texts), bool)
        seeded[near.line[np.isin(near.feat, seeds[name])]] = True
        has[near.doc[seeded & bad_line]] = True
        extra = np.hstack([extra, _sigmoid(link(name, near, y * has, extra))[:, None]])
    all_ = np.zeros((len(doc), extra.shape[1]))
    all_[:, 0], all_[gate] = p, extra
    link(CHAIN[-1], data, y, all_)
    return Chain(links, words.masked), measures


def score_texts(chain: Chain, texts: list[str | None], words: _Words | None = None) -> np.ndarray:
    """The probability of each link for each text, that of its highest line: an array [text, link]. A text without words has 0.

    Lines to which the first link gives less than GATE have 0 in the categories' links.
    """
    words = words if words is not None else _Words(chain.masked)
    doc, line, feat = features(*words.of(texts), words)
    out = np.zeros((len(texts), len(chain.links)))
    if not len(doc):
        return out
    (w, v), none = chain.links[0], np.zeros((len(doc), 0))
    p = _sigmoid(line_scores(line, w[feat], len(doc), v, none))
    np.maximum.at(out[:, 0], doc, p)
    gate, place = p >= GATE, np.cumsum(p >= GATE) - 1
    seen = gate[line]
    near, near_feat, extra = place[line[seen]], feat[seen], p[gate][:, None]
    for i, (w, v) in enumerate(chain.links[1:-1], 1):
        q = _sigmoid(line_scores(near, w[near_feat], len(extra), v, extra))
        np.maximum.at(out[:, i], doc[gate], q)
        extra = np.hstack([extra, q[:, None]])
    all_ = np.zeros((len(doc), extra.shape[1]))
    all_[:, 0], all_[gate] = p, extra
    w, v = chain.links[-1]
    np.maximum.at(out[:, -1], doc, _sigmoid(line_scores(line, w[feat], len(doc), v, all_)))
    return out


def labelled_texts(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, limit_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts of labelled documents and how likely each is toxic; at most ``limit`` documents of ``limit_bytes`` together, those of the smallest hash of their id.

    Repeated rows of a rater count once, null ratings not at all; documents without text are left out. Ids and sizes are collected first, then only the texts within the bounds.
    """
    votes = labels.select("doc_id", "rater", "toxic").where(F.col("toxic").isin(0, 1)).distinct()
    votes = votes.groupBy("doc_id").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("votes"))
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(votes, "doc_id").groupBy("doc_id").agg(F.sum("bytes").alias("bytes"), F.first("toxic").alias("toxic"), F.first("votes").alias("votes"))
    rows = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toArrow()
    within = rows.take(pa.array(np.flatnonzero(np.cumsum(rows["bytes"].to_numpy()) <= limit_bytes)))
    if not within.num_rows:
        return [], np.empty(0)
    chosen = documents.sparkSession.createDataFrame(within.select(["doc_id", "toxic", "votes"]))  # bounded by ``limit``
    rows = texts.join(F.broadcast(chosen), "doc_id").toArrow().sort_by("doc_id")
    return rows["text"].to_pylist(), true_labels(rows["toxic"].to_numpy().astype(float), rows["votes"].to_numpy().astype(float))


def toxicity_scores(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """``doc_id, *keep, p_<category>..., p_toxic`` of every row of the documents, from the whole text.

    The chain is fitted on a bounded sample of the labelled documents. A null text, or one without words, scores 0; without
    labels, or without any toxic one, everything scores next to 0. Rows are never merged.
    """
    chain_, _ = fit_chain(*labelled_texts(documents, labels, limit))
    shared = documents.sparkSession.sparkContext.broadcast(chain_.small())
    names = [f"p_{c}" for c in CHAIN[1:]]
    rows = documents.select("doc_id", *keep, "text")
    schema = rows.select("doc_id", *keep, *(F.lit(0.0).alias(n) for n in names)).schema

    def score(batches):
        fitted = shared.value.whole()
        words = _Words(fitted.masked)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                p = score_texts(fitted, part["text"].to_pylist(), words)[:, 1:]
                yield pa.RecordBatch.from_arrays([part[c] for c in ("doc_id", *keep)] + [pa.array(p[:, j]) for j in range(len(names))], names=["doc_id", *keep, *names])

    return rows.mapInArrow(score, schema)


def source_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, toxic, rate`` and the share of each category, sources compared without case and outer blanks (null is a source of its own)."""
    hit = lambda c: F.avg((F.col(c) >= threshold).cast("double"))
    s = scores.withColumn("source", plain_name(F.col("source")))
    return s.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum((F.col("p_toxic") >= threshold).cast("bigint")).alias("toxic"), F.round(hit("p_toxic"), 6).alias("rate"), *(F.round(hit(f"p_{c}"), 6).alias(f"{c}_rate") for c in SEEDS)
    )
