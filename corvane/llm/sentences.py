"""Problem 9: sentence boundaries across languages and scripts.

Each text is read as Markdown blocks (fenced blocks skipped, a heading is one unit, a list
item or paragraph ends at a blank line or the next item). Within a block, semi-Markov dynamic
programming selects the sequence of whole spans with the highest sum of span scores. A span is
scored jointly by

* its length in words,
* its opening word (case, script, month names, connectives),
* its closing word and punctuation (abbreviations, initials, ordinals, ellipses),
* the balance of quotations, parentheses and back-ticks within it: a pair must close in the
  span in which it opens, and a pair may end a span of its own only if it opens it.

Classes of words and marks carry set scores; the words themselves, and the lengths, carry scores
fitted on all texts, which label themselves: what begins or ends a block begins or ends a sentence, a full stop before a lower-case word seldom does, a word behind another one opens
nothing, and a block with a single closing mark is one sentence.

Up to ``TAIL`` words every length has its own score, beyond it falls off in a line. So each end
needs the starts at most ``TAIL`` words before it and one running maximum for all others: exact in
linear time, whatever the length of a text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import stage

SCHEMA = "doc_id bigint, start_pos int, end_pos int"
HELD = 200_000  #: counts a task holds before it hands them on
LEAST = 5  #: observations from which on a word has a score of its own
TAIL = 40  #: words from which on the length term is linear
MET = 20_000  #: words of up to 32 characters whose scores a model keeps, closing and opening ones each
_SLOPE = 0.01
_OUT = -1e18

# Abbreviations that a further word always follows, by language.
_NEVER = set(
    """dr mr mrs ms prof st rev hon gen col lt capt sgt fig figs sec secs eq eqs ch chap vol vols ed eds no nos nr pp p
    cf approx ver vers rel incl excl resp esp viz dept est tel ext art par abb vgl bzw ca bspw evtl ggf inkl exkl sog
    str tab kap hrsg u.a z.b d.h i.d.r lt ing dipl frau hr fr dra sra sr srta lic ej p.ej pág págs núm art cap ref
    env ex éd chap m mme mlle mm p.ex av apr réf bkz örn ör yakl doç yrd av sn böl şek çev haz bkn krş yy e.g i.e c.f
    d v vv s t.c ш г ул стр рис см""".split()
)
# Those that are units behind a number.
_UNITS = set("s m d p v".split())
# Abbreviations that may also end a sentence.
_MAYBE = set("etc inc ltd co corp usw vs vb vd jr sr al a.m p.m am pm gmbh a.ş s.a v.b a.g u.s u.k e.v ff sq usf s.l".split())
# Month names, which turn a number with a full stop into a date.
_MONTHS = set(
    """januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug
    sep okt nov dez ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık""".split()
)
# German words that stand before an ordinal or a date.
_BEFORE_ORDINAL = set("am vom zum im der den dem des die das ab bis und seit beim jeder jede jedes dieser".split())
# Words that often open a sentence, in lower case too; words that go on with a sentence rather than open one.
_DETERMINERS = set(
    "every each one two our nobody the this these a an un une chaque der die das ein eine jeder cada el los las le les bir her".split()
)
_GOES_ON = set("and or but nor und oder aber sondern ve veya ama y o pero et ou mais".split())

# all cases begin with one class, which a search finds quickly; a look back then tells them apart
_CAND = re.compile(
    r"[.!?…؟۔।॥。！？｡](?:"
    r"(?:(?<=[.!?…؟۔।॥])[.!?…؟۔।॥]*|(?<=[。！？｡])[。！？｡]*[.!?…。！？｡]*)[\"'”’“»«)\]」』）】›]*(?=\s|$)"
    r"|(?:(?<=[。！？｡])[。！？｡]*|(?<=[!?])[!?]*(?=[\"”’」』）】]*[぀-ヿ㐀-鿿]))[\"”’」』）】]*)"
)
_PAIRS = re.compile(r"[\"“”„«»「」『』()（）\[\]【】`]")
_CLOSES = {"”": "“„", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "】": "【"}
_EITHER = {'"': '"', "“": "„", "»": "«", "«": "»"}  #: marks that open, unless they close one of these
_FENCE = re.compile(r"(`{3,}|~{3,})")
_HEAD = re.compile(r"#{1,6}[ \t]+")
_BULLET = re.compile(r"[-*+][ \t]+")
_NUMBER = re.compile(r"(\d{1,9})[.)][ \t]+")
_THAI = re.compile(r"[฀-๿]")
_SPACES = re.compile(r"\s+")
_WORDY = re.compile(r"\w")
_SOLID = re.compile(r"\S")
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOTTED = re.compile(r"(?:\w\.)+\w")
_BEHIND_WORD = re.compile(r" (?<=[^\W\d_] )([^\W\d_]+)")
_STOP_GOES_ON = re.compile(r"\. (?=[a-zà-ÿğışçöü])")
_GERMAN = re.compile(r"[äöüß]|\b(?:und|der|die|wird|nicht)\b")
_OPENING = "\"'“„«‹([{¿¡`*_‘（「『"
_CJK_END = set("。！？｡")


def _regions(seg: str) -> tuple[list[int], list[int], list[str]]:
    """Outermost protected regions of a block: starts, ends (exclusive), opening characters."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each opening character, its places in the stack
    found: list[tuple[int, int, str]] = []
    m = _PAIRS.search(seg)
    while m:
        c, i = m.group(), m.start()
        behind = i + 1
        if c == "`":
            tick = seg.find("`", behind)
            if tick >= 0:
                behind = tick + 1
                found.append((i, behind, "`"))
        else:
            want = _CLOSES.get(c, "")
            close = ""
            if stack:
                fits = want or _EITHER.get(c, "")
                if stack[-1][0] in fits:
                    close = stack[-1][0]
                else:
                    close = max((o for o in fits if places.get(o)), key=lambda o: places[o][-1], default="")
            if close:
                while stack:
                    o, s = stack.pop()
                    places[o].pop()
                    if o == close:
                        found.append((s, behind, o))
                        break
            elif not want:
                places.setdefault(c, []).append(len(stack))
                stack.append((c, i))
        m = _PAIRS.search(seg, behind)
    if not found:
        return [], [], []
    found.sort(key=lambda r: (r[0], -r[1]))
    starts, ends, kinds = [], [], []
    for s, e, o in found:
        if not ends or s >= ends[-1]:
            starts.append(s)
            ends.append(e)
            kinds.append(o)
    return starts, ends, kinds


class Model:
    """Scores of closing words, opening words and lengths."""

    def __init__(self, close: dict[str, float] | None = None, opening: dict[str, float] | None = None, length: list[float] | None = None):
        self.close = close or {}
        self.opening = opening or {}
        self.length = length or [0.0, -1.0, -0.25] + [0.0] * (TAIL - 3)
        self.most = max(self.length)
        # words met so far with what ``_closing_word`` and ``_opening_word`` give
        self.closes: dict[str, float | None] = {}
        self.opens: dict[str, float] = {}


def fitted(counts: list[tuple[str, str, int, int]]) -> Model:
    """Model from rows (what, word or length, times seen as a sentence's end or start, times seen otherwise); no word: rare ones together."""
    close, opening = {}, {}
    starts = sum(p for kind, _, p, _ in counts if kind == "open") or 1
    others = sum(n for kind, _, _, n in counts if kind == "open") or 1
    lengths: Counter[int] = Counter()
    for kind, key, p, n in counts:
        if kind == "length":
            lengths[int(key)] += p
        elif key is not None and p + n >= LEAST:
            if kind == "close":
                close[key] = max(-3.0, min(0.7, 0.7 * math.log((p + 1) / (n + 1))))
            else:
                odds = math.log((p + 0.5) / starts) - math.log((n + 0.5) / others)
                opening[key] = max(-0.8, min(0.8, 0.3 * odds))
    if sum(lengths.values()) < 100:
        return Model(close, opening)
    # only shortness costs: as rare as a length is beside the most common one
    top = max(lengths.values())
    length, best = [], 0
    for n in range(TAIL):
        best = max(best, lengths[n])
        length.append(max(-1.0, 0.4 * math.log((best + 1) / (top + 1))))
    return Model(close, opening, length)


def observe(text: str, into: dict[tuple[str, int], Counter[str]]) -> None:
    """Adds what the blocks of a text tell about words and lengths; ``into``: counts by kind and 0 (as a sentence's end or start) or 1."""
    starts, behind = [], []
    close = into["close", 1]
    for heading, s, e in blocks(text):
        if heading:
            continue
        seg = text[s:e]
        first = _LETTERS.match(seg)
        if first:
            starts.append(first.group())
        behind += _BEHIND_WORD.findall(seg)
        if len(behind) > 1000:
            into["open", 1].update(behind)
            behind.clear()
        for m in _STOP_GOES_ON.finditer(seg):
            at = m.start()
            if at and not seg[at - 1].isspace():
                close[_last_word(seg, at)[0].lstrip(_OPENING).lower()] += 1
        if seg.endswith("."):
            last = seg[:-1].rsplit(None, 1)
            if last:
                into["close", 0][last[-1].lstrip(_OPENING).lower()] += 1
        if seg.isascii():
            only = _CAND.search(seg)
            if only and only.end() == len(seg):
                into["length", 0][str(min(len(seg.split()), TAIL))] += 1
    into["open", 0].update(starts)
    into["open", 1].update(behind)


def _last_word(seg: str, at: int) -> tuple[str, str]:
    """What stands before ``at`` without white space (nothing, if white space does), and the character before that and its white space."""
    if not at or seg[at - 1].isspace():
        begin, word = at, ""
    else:
        near = seg[max(0, at - 32) : at].rsplit(None, 1)
        if len(near) == 2:
            return near[1], near[0][-1]
        begin = at
        while begin and not seg[begin - 1].isspace():
            begin -= 1
        word = seg[begin:at]
    while begin and seg[begin - 1].isspace():
        begin -= 1
    return word, seg[begin - 1 : begin]


def _opening_word(word: str, model: Model) -> float:
    """Score of opening with ``word``, which is no identifier's beginning."""
    c = word[0]
    known = model.opening.get(word, 0.0)
    if c.islower():
        if word in _DETERMINERS:
            return -0.2
        if word in _GOES_ON:
            return -2.2
        return -1.3 + min(known, 0.4)
    if word.lower() in _MONTHS:
        return -1.5
    return 1.0 + known


def _opening(seg: str, at: int, model: Model) -> float:
    """Score of a span that opens at ``at``, which is no white space."""
    core = at
    while core < len(seg) and seg[core] in _OPENING:
        core += 1
    c = seg[core] if core < len(seg) else seg[at]
    if c.isdigit():
        return -1.0 if core == at else 1.0
    if not c.isalnum() and not c.islower():
        return -1.0 if core == at else 1.0
    m = _LETTERS.match(seg, core)
    word = m.group() if m else c
    if c.islower() and (core > at or m and seg.startswith("_", m.end())):
        return 1.0  # an identifier, or what stands in quotation marks, keeps its case
    score = model.opens.get(word)
    if score is None:
        score = _opening_word(word, model)
        _keep(model.opens, word, score)
    return score


def _keep(known: dict, word: str, score: float | None) -> None:
    if len(word) <= 32:
        if len(known) >= MET:
            known.clear()
        known[word] = score


def _closing_word(word: str, model: Model) -> float | None:
    """Score of closing with a full stop behind ``word``; None if what stands before the word decides."""
    if not word:
        return -4.0  # opening marks only
    low = word.lower()
    if low in _NEVER:
        return None if low in _UNITS else -7.0
    if low in _MAYBE:
        return 0.5
    if len(word) == 1 and word.isalpha():
        return None
    if _DOTTED.fullmatch(word) and not any(c.isdigit() for c in word):
        return -6.0
    if "ऀ" <= word[-1] <= "ॿ":
        return -6.0 if len(word) <= 3 else 1.0
    if word.isdigit() and len(word) <= 4:
        return None
    return 2.0 + model.close.get(low, 0.0)


def _closing(seg: str, at: int, end: int, closed: str, german, model: Model) -> float:
    """Score of a span that closes with the marks ``seg[at:end]``; ``closed`` opened the pair that ends there."""
    mark = seg[at]
    if mark in _CJK_END:
        return -6.0 if closed and closed != "`" else 4.0
    if closed and closed != "`":
        return 0.5
    marks = seg[at:end]
    if marks != ".":
        if mark in "।॥۔":
            return 4.0
        if "!" in marks or "?" in marks or "؟" in marks:
            return 3.0
        if mark == "…" or marks.startswith(".."):
            return 0.7
    raw, before = _last_word(seg, at)
    score = model.closes.get(raw, _OUT)
    if score == _OUT:
        score = _closing_word(raw.lstrip(_OPENING), model)
        _keep(model.closes, raw, score)
    if score is not None:
        return score
    word = raw.lstrip(_OPENING)
    behind_number = before.isdigit()
    if len(word) == 1 and word.isalpha():
        if word.lower() in _NEVER and not behind_number:
            return -7.0
        return 2.0 if behind_number and word.islower() else -6.0
    if german():
        stop = at - len(raw)
        while stop and seg[stop - 1].isspace():
            stop -= 1
        if _last_word(seg, stop)[0].lower() in _BEFORE_ORDINAL:
            return -4.0
    return 1.2


def _split(text: str, s: int, e: int, out: list[tuple[int, int]], german, model: Model) -> None:
    seg = text[s:e]
    # ends of spans, where the next one starts, scores of closing there and of opening behind it, the pair that ends there
    cut, then, closing, opening, pair = [0], [0], [0.0], [0.0], [-1]
    starts: list[int] = []
    ends: list[int] = []
    kinds: list[str] = []
    thai = not seg.isascii() and _THAI.search(seg) is not None and 2 * len(_THAI.findall(seg)) > sum(c.isalpha() for c in seg)
    if thai:
        starts, ends, kinds = _regions(seg)
        for m in _SPACES.finditer(seg):
            if "\n" not in m.group() and (_THAI.match(seg[m.start() - 1]) or _THAI.match(seg[m.end()])):
                cut.append(m.start())
                then.append(m.end())
                closing.append(3.0)
                opening.append(0.0)
                pair.append(-1)
    else:
        size = len(seg)
        for m in _CAND.finditer(seg):
            at, end = m.span()
            if end == size:  # a block ends with its last character that is no white space
                break
            nxt = end + 1 if seg[end].isspace() else end
            if seg[nxt].isspace():
                nxt = _SOLID.search(seg, nxt).start()
            if len(cut) == 1:
                starts, ends, kinds = _regions(seg)
            k = bisect_right(starts, at) - 1 if starts else -1
            inside = k >= 0 and at < ends[k] <= end
            cut.append(end)
            then.append(nxt)
            closing.append(_closing(seg, at, end, kinds[k] if inside else "", german, model))
            opening.append(_opening(seg, nxt, model) if seg[at] not in _CJK_END else 0.0)
            pair.append(starts[k] if inside and kinds[k] in "([（【" else -1)
    if len(cut) == 1:
        if _WORDY.search(seg):
            out.append((s, e))
        return
    cut.append(len(seg))
    then.append(len(seg))
    closing.append(0.0)
    opening.append(0.0)
    pair.append(-1)
    # pairs that are open at each end
    loose = [bisect_right(starts, p - 1) - bisect_right(ends, p) for p in cut] if starts else [0] * len(cut)
    count, letters = [0], [0]
    words = lettered = 0
    # best sums of spans up to each end, with the score of opening a span there, and the highest of them so far
    length, most = model.length, model.most
    sums, tops, back = [0.0], [0.0], [-1]
    far, far_from, reached = _OUT, -1, 0  # the best start more than TAIL words before, with its length term
    for j in range(1, len(cut)):
        piece = seg[cut[j - 1] : cut[j]]
        n = len(piece.split())
        if n < 3 and len(piece) > 6 and not piece.isascii():
            n = 3  # scripts without spaces: characters stand for words
        words += n
        if _LETTER.search(piece):
            lettered += 1
        at = pair[j]
        while reached < j and words - count[reached] >= TAIL:
            v = sums[reached] + _SLOPE * count[reached]
            if v > far:
                far, far_from = v, reached
            reached += 1
        value, arg = _OUT, 0
        # the later of equal starts; no start before i is better than the highest sum so far at the best length
        for i in range(j - 1, reached - 1, -1):
            if tops[i] + most <= value:
                break
            v = sums[i] + length[words - count[i]]
            if letters[i] == lettered:
                v -= 6.0
            if at >= 0 and at != then[i]:
                v -= 4.0  # the pair that ends the span didn't open it
            if v > value:
                value, arg = v, i
        if far_from >= 0:
            v = far - _SLOPE * (words - TAIL)
            if v > value:
                value, arg = v if at < 0 else v - 4.0, far_from
        value = value + closing[j] - 8.0 * loose[j]
        value += opening[j] - 8.0 * loose[j]
        count.append(words)
        letters.append(lettered)
        sums.append(value)
        tops.append(value if value > tops[-1] else tops[-1])
        back.append(arg)
    ways = []
    j = len(cut) - 1
    while j > 0:
        ways.append((back[j], j))
        j = back[j]
    for i, j in reversed(ways):
        a, b = cut[i], cut[j]
        if letters[i] == letters[j] and not _WORDY.search(seg, a, b):
            continue
        # ends are no white space, nor is what ``then`` names
        out.append((s + then[i] if i else s + len(seg) - len(seg.lstrip()), s + b))


def blocks(text: str) -> Iterator[tuple[bool, int, int]]:
    """(whether it is a heading, start, end) of every block of a Markdown text that holds sentences."""
    lines = text.split("\n")
    pos = 0
    fence = ""
    begin = stop = -1
    number = 0
    for k, line in enumerate(lines):
        here, pos = pos, pos + len(line) + 1
        if not k and line[:1] == "﻿":
            here, line = here + 1, line[1:]
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            continue
        if not bare:
            if begin >= 0:
                yield False, begin, stop
                begin = -1
            continue
        c = bare[0]
        content = here + line.find(c)
        end = content + len(bare)
        item = -1
        if c in "`~":
            m = _FENCE.match(bare)
            if m and (c == "~" or "`" not in bare[m.end() :]):
                if begin >= 0:
                    yield False, begin, stop
                    begin = -1
                fence = m.group()
                continue
        elif c == "#":
            m = _HEAD.match(bare)
            if m:
                if begin >= 0:
                    yield False, begin, stop
                    begin = -1
                number = 0
                yield True, content + m.end(), end
                continue
        elif c in "-*+":
            m = _BULLET.match(bare)
            if m:
                item = content + m.end()
        elif c.isdigit():
            m = _NUMBER.match(bare)
            if m:
                n = int(m.group(1))
                if n == 1 or n == number + 1 and number:
                    item, number = content + m.end(), n
                elif begin < 0:
                    # an item if the next number follows within the paragraph
                    after = k + 1
                    while after < len(lines) and (later := lines[after].strip()):
                        m2 = _NUMBER.match(later)
                        if m2 and int(m2.group(1)) == n + 1:
                            item, number = content + m.end(), n
                            break
                        after += 1
        if item >= 0:
            if begin >= 0:
                yield False, begin, stop
            begin, stop = item, end
        elif begin < 0:
            begin, stop, number = content, end, 0
        else:
            stop = end
    if begin >= 0:
        yield False, begin, stop


_PLAIN = Model()


def sentences(text: str | None, model: Model = _PLAIN) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text``, in order."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    state: list[bool] = []

    def german() -> bool:
        if not state:
            state.append(bool(_GERMAN.search(text)) and not re.search(r"[ğışİ]", text))
        return state[0]

    for heading, s, e in blocks(text):
        if not heading:
            _split(text, s, e, out, german, model)
        elif _WORDY.search(text, s, e):
            out.append((s, e))
    return out


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], Counter[str]] = defaultdict(Counter)

    def counts() -> pa.RecordBatch:
        rows = [(kind, key, n * (1 - which), n * which) for (kind, which), words in seen.items() for key, n in words.items()]
        cols = zip(*rows) if rows else [[]] * 4
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "key", "p", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            observe(t, seen)
            if sum(map(len, seen.values())) > HELD:
                yield counts()
                seen.clear()
    yield counts()


def fit(docs: DataFrame) -> Model:
    """Model fitted on all texts."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    counts = texts.mapInArrow(_observed, "kind string, key string, p bigint, n bigint").groupBy("kind", "key").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # what opened or didn't open a sentence is counted over all words, also those too rare for a score of their own
    kept = F.when((F.col("kind") == "length") | (F.col("p") + F.col("n") >= LEAST), F.col("key"))  # else null
    return fitted([tuple(r) for r in counts.groupBy("kind", kept.alias("key")).agg(F.sum("p"), F.sum("n")).collect()])


def _run(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in batches:
        ids, starts, ends = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s, e in sentences(t, model):
                ids.append(i)
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"]
        )


def split_sentences(docs: DataFrame) -> DataFrame:
    """One row per sentence: ``doc_id start_pos end_pos``, in code points, end exclusive.

    Needs ``doc_id`` and ``text``; further columns are ignored. Null, empty and blank texts have
    no sentences; a null ``doc_id`` is kept as such; repeated rows give each sentence once;
    equal texts under several ids are each split; an empty table gives no rows. Word and length
    scores are fitted on all texts, each row once.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = stage(src.filter(F.length("text") > 0).distinct(), "texts")
    shared = docs.sparkSession.sparkContext.broadcast(fit(src))
    return src.mapInArrow(partial(_run, shared=shared), SCHEMA)
