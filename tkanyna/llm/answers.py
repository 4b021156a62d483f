"""Prompt and response pairs whose response is no proper answer, each with one kind of defect.

The first that holds counts: `empty` (null, or no letter or digit), `copy`, `refusal`, `other_language`, `truncated`.

* Copies: the shingles of three words of the prompt stand in the response, their longest common subsequence is the whole
  prompt, and it stands there as one run. What is left beside it is a lead-in, unless it declines (a refusal) or renders
  the prompt again.
* Refusals: templates in several languages, sequences of slots that each hold words or stems, are aligned with the
  response word by word. A matched slot gains, words between slots and missing slots cost; a template whose score stays
  near the best it can reach is a refusal.
* Other languages: most words are in Latin letters, or the letters' runs of three are likelier in the corpus's own
  foreign answers than in its own language (`Language`). Both models are counts over the whole corpus, told apart by
  letters that occur in one of them only.

Only a response that doesn't render its prompt (`reach`) can be a refusal or another language, so that a prompt that
itself apologises is rendered without a defect. A null prompt makes no copy and no truncation. Numbering, quotes and
separators around an answer are no defect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tkanyna.llm.align import alike, fold, reach
from tkanyna.llm.truncation import LEFTOVER, is_cut
from tkanyna.llm.words import words

LEAD = 8  # words beside a copy of a prompt of one or two words
QUOTED = re.compile(r"[«\"“„][^«»\"“”„]*[»\"”]")
#: Slots of a template are separated by blanks, the words of a slot by strokes; a star ends a stem, and a template that
#: ends in <> holds in either order.
TEMPLATES = """
не можу/можемо/може/зможу/зможемо/зможе/вдасться/вдалося/вдалось/буду/будемо/можна/вмію/вміємо/наважуся/дозволено/дозволяє*/дозволен*/передбачен*/підтримує*/надано/здатн*/готов*/хочу/берусь/беруся/візьмусь/візьмуся/вийде/хотів*
не маю/маємо змоги/права/можливості/дозволу/повноважень/доступу
не в змозі/силі/силах/праві
відмовля*/відмовлю*/відмовлен*/відмовим*/відмовит*/відмовився/відмовилася/відмова/відмову
утрима* від
неможлив*/нездатн*/недоступн*/неприпустим*/неприйнятн*/заборонен*/забороня*/заблокован*
мовна/мовну/мовної/мовною/мовна/мовні модель/моделі/моделлю
штучн* інтелект*
запит*/прохання/текст*/речення/контент*/зміст*/завдання/переклад*/відповід* відхил*/відхилен*/заблокован*/суперечит*/порушу*/недопустим*/виходить/обмежен*/блоку* <>
суперечит*/суперечат*/порушу*/всупереч/проти/згідно/через правил*/принцип*/політи*/норм*/вимог*/умов*/засад*/обмежен* <>
поза/понад/за моїми/моїх/межами/межі можливост*/компетенц*/повноважен*/можливостей
міркувань/вимог/правил/політики безпеки
правила не
вибач*/перепрош*/пробач*/шкода/прикро/жаль але/проте/та/однак/що не/ні
i/we can't/cannot/couldn't/won't/don't/shouldn't/can/must/will/am/are/do/refuse/decline not/decline/refuse/help/assist/comply/provide/translate/answer/process/produce/able
can't/cannot/couldn't/won't/unable/refuse*/declin*/forbidden/prohibited/inappropriate
will/can/not/am/is not/able/allowed/permitted/available/supported/possible/going/comfortable
language model
content/usage/safety policy/policies/rules/guidelines
an ai
against/violat*/contrary/outside/beyond my/our/the/content/these policy/policies/guidelines/rules/principles/scope/capabilities/abilities/instructions
request/prompt/input/content denied/rejected/blocked/refused/declined
blocked/unavailable
не могу/можем/может/смогу/сможем/удастся/удалось/буду/разрешено/поддержива*/вправе/готов*/позволя*
отказыва*/откажу*/вынужден* отказ*/переводить/перевести/отвечать/ответить/отклон*/выполнить
отказываюс*/отказываемся
невозможно/запрещено/недоступ*/заблокирован*
языковая модель
запрос*/просьба/текст*/контент* отклон*/противореч*/наруша*/заблокирован* <>
противореч*/наруша* правил*/принцип*/политик*/норм*/моим/нашим
nie mogę/mogłem/mogłam/możemy/potrafię/wolno/będę/jestem/chcę/udało
odmawia*/odmówi*/muszę odmówić/odrzuc*/przetłumacz*/odpowiedzi/wykonania/tłumaczenia
odmawiam/odmawiamy/niemożliw*/zablokowan*/odrzucon*/niedostępn*
model* językow*
przepraszam/niestety/przykro ale/nie
narusza/sprzeczn*/niezgodn* zasad*/regulamin*/polityk*/z
nu pot/putem/voi/vom/este/am/reușesc/pot
refuz*/imposibil*/blocat*/respins*/indisponibil*
model* lingvistic*/de limbaj*/lingvistic*
îmi pare rău
încalcă/contravine regul*/politic*/principi*
ich/wir kann/können/darf/werde/muss/will
kann/darf nicht
leider/sprachmodell/ablehnen/désolé/nemohu/nemôžem
je/nous ne peux/pouvons/suis/veux
no puedo/podemos/es
lo siento
nem tudok/tudom
non posso/possiamo
не магу/мога/можам
"""  # fmt: skip
MATCH, SKIP, MISS = 2.0, -0.3, -1.5  # what a matched slot, a word between slots and a missing slot score
SLACK, LOOSE = 1.3, 3.6  # how far a template of up to three slots, or of more, may stay below its best score
RUSSIAN = re.compile("[ыэъё]")
UKRAINIAN = re.compile("[іїєґ']")
LATIN = re.compile("[a-zà-ɏ]")
CYRILLIC = re.compile("[а-яіїєґ]")
SLOTS = 1 << 16  # counts of runs of three letters
PRIOR = 1000.0  # runs of three letters, each as likely, that either model has seen before


def _templates() -> list[list[tuple[frozenset[str], tuple[str, ...]]]]:
    out = []
    for line in filter(None, TEMPLATES.strip().split("\n")):
        slots = [(frozenset(w for w in slot.split("/") if w[-1] != "*"), tuple(w[:-1] for w in slot.split("/") if w[-1] == "*")) for slot in line.removesuffix(" <>").split(" ")]
        out += [slots, slots[::-1]] if line.endswith(" <>") else [slots]
    return out


SEQUENCES = _templates()


@lru_cache(maxsize=100_000)
def slots_of(word: str) -> tuple[tuple[int, int], ...]:
    """(template, slot) of each slot that holds the word."""
    return tuple((t, k) for t, slots in enumerate(SEQUENCES) for k, (whole, stems) in enumerate(slots) if word in whole or word.startswith(stems))


def declines(ws: list[str]) -> bool:
    """Whether a template of a refusal aligns with a part of the words."""
    at: dict[int, list[tuple[int, int]]] = {}
    for place, w in enumerate(ws):
        for t, k in slots_of(w):
            at.setdefault(t, []).append((place, k))
    for t, hits in at.items():
        size = len(SEQUENCES[t])
        need = MATCH * size - (0 if size == 1 else SLACK if size < 4 else LOOSE)
        if len({k for _, k in hits}) * MATCH < need:
            continue
        # best[k]: the score of an alignment of the first k slots that ends with the latest word
        best, before = [MISS * k for k in range(size + 1)], 0
        for place, group in groupby(hits, key=itemgetter(0)):
            rest = [0.0] + [b + SKIP * max(0, place - before - 1) for b in best[1:]]
            best, before = [0.0] + [b + SKIP for b in rest[1:]], place
            for _, k in group:
                best[k + 1] = max(best[k + 1], max(rest[j] + MISS * (k - j) for j in range(k + 1)) + MATCH)
            if max(b + MISS * (size - k) for k, b in enumerate(best)) >= need:
                return True
    return False


def letter_runs(text: str) -> np.ndarray:
    """The slots of the runs of three letters of a text; all that isn't Cyrillic counts as a blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where((codes >= 0x430) & (codes < 0x530), codes, 32)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    return ((codes[:-2] * 1009 + codes[1:-1]) * 1013 + codes[2:]) % SLOTS


@dataclass
class Language:
    """Counts of runs of three letters in texts of the corpus's own language, and in its foreign Cyrillic ones."""

    own: np.ndarray
    other: np.ndarray

    def foreign(self, text: str) -> float:
        """How much likelier the text is among the foreign ones, as a logarithm."""
        runs = letter_runs(text)
        score = lambda n: np.log((n[runs] + PRIOR / SLOTS) / (n.sum() + PRIOR)).sum()
        return float(score(self.other) - score(self.own))


def language_of(df: DataFrame, prompt: str, response: str) -> Language:
    """The models of all prompts and responses: texts with letters that Russian lacks are its own, those with letters
    that Ukrainian lacks foreign, and others count for neither."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            texts: list[list[str]] = [[], []]
            for text in [*batch["a"].tolist(), *batch["b"].tolist()]:
                if text:
                    low = text.lower()
                    strange, ours = bool(RUSSIAN.search(low)), bool(UKRAINIAN.search(low))
                    if strange != ours:
                        texts[strange].append(text)
            for side in (0, 1):
                if texts[side]:
                    total[side] += np.bincount(letter_runs("\n".join(texts[side])), minlength=SLOTS)
        side, slot = np.nonzero(total)
        yield pd.DataFrame({"side": side.astype(np.int32), "slot": slot, "n": total[side, slot]})

    rows = df.select(F.col(prompt).alias("a"), F.col(response).alias("b")).mapInPandas(count, "side int, slot bigint, n bigint")
    found = rows.groupBy("side", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, SLOTS), np.int64)
    table[found["side"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return Language(table[0], table[1])


def shingle_containment(prompt: list[str], response: list[str], k: int = 3) -> float:
    """The share of the prompt's runs of k words that occur in the response."""
    have = {tuple(response[i : i + k]) for i in range(len(response) - k + 1)}
    runs = [tuple(prompt[i : i + k]) for i in range(len(prompt) - k + 1)]
    return sum(r in have for r in runs) / len(runs) if runs else float(prompt == response and bool(prompt))


def run_at(prompt: list[str], response: list[str]) -> int:
    """Where the prompt stands in the response as one run of words, or -1."""
    n = len(prompt)
    return next((i for i in range(len(response) - n + 1) if response[i] == prompt[0] and response[i : i + n] == prompt), -1) if n else -1


def common(prompt: list[str], response: list[str]) -> int:
    """The length of the longest common subsequence, by bits of long integers."""
    at: dict[str, int] = {}
    for i, w in enumerate(prompt):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(prompt)) - 1
    row = full
    for w in response:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(prompt) - row.bit_count()


def unlike(prompt: list[str], response: list[str]) -> bool:
    """Whether the response renders no beginning of the prompt."""
    if not prompt or not response:
        return True
    known = {fold(w) for w in prompt}
    if sum(fold(w) in known for w in response) * 2 < len(response):
        return True
    return reach(response, prompt)[0] * 2 < len(response)


def foreign(ws: list[str], language: Language | None = None) -> bool:
    """Whether most words are in Latin letters, or the Cyrillic ones are neither Ukrainian nor dialect."""
    latin = sum(bool(LATIN.search(w)) for w in ws)
    cyrillic = [w for w in ws if CYRILLIC.search(w)]
    if latin > len(cyrillic):
        return True
    text = " ".join(cyrillic)
    if not text:
        return False
    if language and (score := language.foreign(text)):
        return score > 0
    return bool(RUSSIAN.search(text)) or not UKRAINIAN.search(text)


def russian(ws: list[str]) -> bool:
    """Whether more than a quarter of the words have a letter of Russian that Ukrainian lacks."""
    return bool(RUSSIAN.search(" ".join(ws))) and sum(bool(RUSSIAN.search(w)) for w in ws) * 4 > len(ws)


def copied(prompt: list[str], response: list[str]) -> str | None:
    """copy if the response repeats the prompt word for word, or refusal if it declines at length around it.

    At most LEAD words before and after it are a lead-in. Of more words, all that is left over beside the prompt must
    not render it again; a prompt too short for a shingle says nothing among so many.
    """
    n, m = len(prompt), len(response)
    if not 0 < n <= m or prompt[n // 2] not in response or shingle_containment(prompt, response) < 1.0:
        return None
    if common(prompt, response) < n or (at := run_at(prompt, response)) < 0:
        return None
    if at <= LEAD and m - at - n <= LEAD:
        return "copy"
    if n < 3:
        return None
    rest = []
    while at >= 0:
        rest, response = rest + response[:at], response[at + n :]
        at = run_at(prompt, response)
    rest += response
    if not rest:
        return "copy"
    have = {fold(w) for w in rest}
    again = sum(fold(w) in have for w in prompt) * 2 >= n or not unlike(prompt, rest)
    if again:
        return None
    return "refusal" if declines(rest) else "copy"


def defect(prompt: str | None, response: str | None, language: Language | None = None) -> str | None:
    """The kind of defect of one pair, or None. Without a language, letters tell the foreign answers."""
    b = words(response)
    if not b:
        return "empty"
    a = words(prompt)
    if a and (kind := copied(a, b)):
        return kind
    if LEFTOVER.search(response):
        b = words(LEFTOVER.sub(" ", response)) or b
        if a and (kind := copied(a, b) or (copied(words(LEFTOVER.sub(" ", prompt)) or a, b) if LEFTOVER.search(prompt) else None)):
            return kind
    known = {fold(w) for w in a}
    shared = sum(fold(w) in known for w in b) * 2 >= len(b)
    if shared and len(b) >= len(a) - 1 and alike(a[-1], b[-1]):
        return "other_language" if russian(b) else None
    rest = words(QUOTED.sub(" ", response)) if QUOTED.search(response) else b
    if len(rest) < 3:
        rest = b
    if unlike(a, rest):
        if declines(rest):
            return "refusal"
        return "other_language" if foreign(b, language) else None
    if russian(b):
        return "other_language"
    return "truncated" if is_cut(response, prompt) else None


def defects(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """A row (key, defect) for each defective pair; a pair delivered twice is judged once per distinct outcome."""

    language = df.sparkSession.sparkContext.broadcast(language_of(df, prompt, response))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [defect(a, b, language.value) for a, b in zip(batch["a"].tolist(), batch["b"].tolist())]
            out = pd.DataFrame({key: batch["row"], "defect": found})
            yield out[out["defect"].notna()]

    given = df.select(F.col(key).alias("row"), F.col(prompt).alias("a"), F.col(response).alias("b")).filter("row is not null")
    return given.mapInPandas(judge, f"{key} bigint, defect string").distinct()
