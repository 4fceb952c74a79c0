"""Problem 5: prompt and response pairs that are unfit for use."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import lookalikes

#: Most labelled rows that the language classifier is fitted on, and its table of hashed character trigrams.
LABELLED, SLOTS = 2000, 1 << 16
#: Chance that text, or a list, ends at a place of which nothing is known, weight of the shorter context, the chance below which an end is none, and the words of the longest context.
PRIOR, LIST_PRIOR, WEIGHT, ENDS, LONGEST = 0.04, 0.5, 2.0, 0.6, 4
#: Most words of a sentence that declines, and of one beside it that says nothing.
DECLINING, ASIDE = 40, 12

# What stands for an absent answer, words for quoting a question, abbreviations that end no sentence.
PLACEHOLDERS = set("null none nil nan na n/a tbd todo tba empty blank undefined unknown missing placeholder no-answer noanswer answer response reply antwort respuesta réponse reponse leer vacío vide".split()) | {"no answer", "no response", "not available", "not applicable", "to be done", "no content", "sin respuesta", "keine antwort", "pas de réponse", "answer here", "your answer here"}
QUOTING = re.compile(r"^(?:(?:you asked|question|q|the question(?: is| was)?|frage|pregunta|question posée|ihre frage|prompt|user)\s*[:>-]|[>\"'“„«]|re:)\s*", re.I)
LABEL = re.compile(r"^(?:answer|response|antwort|respuesta|réponse|a)\s*:\s*", re.I)
ABBREVIATIONS = set("al. e.g. i.e. eq. eqs. fig. figs. sec. no. cf. vs. dr. prof. ref. refs. tab. vol. z.b. bzw. ca. p. pp. ej. ed.".split())

# How assistants decline, by language.
DECLINES = re.compile(
    r"""\b(?:i|we)\b[^.!?]{0,30}\b(?:can ?not|can['’]t|could ?n[o'’]t|could not|unable|not able|won['’]t|will not|must decline|decline|refrain|rather not|(?:do|did) not feel able|do(?: not|n['’]t) have what|do(?: not|n['’]t) have (?:enough|sufficient|any|the) (?:information|context|knowledge)|do(?: not|n['’]t) know)\b"""
    r"""|\bit (?:is|would) not (?:be )?(?:possible|right|appropriate|proper)\b|\bthere is no way (?:for|of)\b|\bno answer can be (?:given|found)\b|\boutside (?:of )?(?:what|the scope|my)\b|\bbeyond (?:me|my)\b|\bno can do\b|\bas an ai\b"""
    r"""|\b(?:excerpts?|papers?|context|documents?|sources?|passages?|texts?)\b[^.!?]{0,30}\b(?:do(?:es)? not|do(?:es)?n['’]t)\b[^.!?]{0,20}\b(?:contain|provide|include|hold|have|offer)\b[^.!?]{0,30}\b(?:enough|information|answer|sufficient)\b"""
    r"""|\bnothing in the\b[^.!?]{0,40}\b(?:address|answer|say|cover|relat)"""
    r"""|\b(?:kann|können|darf|möchte|will) (?:ich|wir)\b[^.!?]{0,60}\bnicht\b|\b(?:ich|wir) (?:kann|können|darf|möchte|muss|müssen)\b[^.!?]{0,60}\b(?:nicht|ablehnen)\b|\bkeine (?:antwort möglich|angaben|informationen|auskunft)\b|\bnicht in der lage\b"""
    r"""|\bje ne (?:peux|puis|suis|saurais)\b[^.!?]{0,20}\b(?:pas|répondre)\b|\bnous ne (?:pouvons|sommes) pas\b|\bne contien(?:t|nent) pas\b[^.!?]{0,30}\b(?:assez|information|réponse)|\bimpossible (?:de|d['’]) ?(?:répondre|donner)|\bje dois (?:refuser|décliner)"""
    r"""|\bno (?:puedo|podemos|me es posible|es posible|soy capaz|estoy en condiciones)\b|\bno contienen?\b[^.!?]{0,30}\b(?:información|respuesta)|\bno hay (?:información|respuesta)|\bdebo (?:rechazar|declinar)"""
    "",
    re.I,
)

# Each match of DECLINES holds one of these in lower case.
DECLINING_WORDS = ("not", "n't", "n’t", "no ", "unable", "declin", "refrain", "outside", "beyond", "as an ai", "nicht", "ablehnen", "keine ", "je ne ", "nous ne ", "ne contien", "impossible ", "je dois ", "debo ")

# Names of languages after the words that ask for one.
ASKED = {
    "en": r"\b(?:in english|auf englisch|en inglés|en ingles|en anglais)\b",
    "de": r"\b(?:in german|auf deutsch|en alemán|en aleman|en allemand)\b",
    "fr": r"\b(?:in french|auf französisch|en francés|en frances|en français)\b",
    "es": r"\b(?:in spanish|auf spanisch|en español|en castellano|en espagnol)\b",
}
_ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}

# Each match of ASKED holds one of the first in lower case; the second are letters that a pattern takes for i, s or k, unlike lower().
ASKED_WORDS, FOLDED = ("engl", "ingl", "angl", "german", "deutsch", "alem", "allem", "fren", "fran", "span", "espa", "castell"), "\u0130\u0131\u017f\u212a"

# What a clause of substance begins with after one that declines.
CONTRAST = re.compile(r"\b(?:but|however|although|though|aber|jedoch|allerdings|mais|cependant|toutefois|pero|sin embargo|aunque)\b|[;:–—]", re.I)
_SUBSTANCE, _SENTENCES = re.compile(r"\d"), re.compile(r"(?<=[.!?])\s+")
_WORDS = re.compile(r"[^\W_]+(?:[.'’][^\W_]+)*")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
_CITED = re.compile(r"\s*\[Excerpts? [^\]]*\]", re.I)
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\"'”)]*$")
_NAME = re.compile(r"\b[A-ZÄÖÜ][^\W\d_]*[a-zà-ÿ][A-Z][^\W\d_]*|\d\S*")


@lru_cache(8)
def plain(text: str) -> str:
    """``lookalikes.plain``, kept for a few texts, as the steps ask for the same of a row."""
    return lookalikes.plain(text)


@lru_cache(8)
def latin(text: str) -> str:
    return lookalikes.latin(text)


class LanguageModel:
    """Naive Bayes over hashed character trigrams."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table  # table: a row of log-rates a slot

    @staticmethod
    def slots(text: str) -> np.ndarray:
        text = " " + " ".join(_NAME.sub(" ", text).lower().split()) + " "
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(code) < 3:
            return np.zeros(0, np.int64)
        key = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
        return (key >> np.uint64(48)).astype(np.int64) & (SLOTS - 1)

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> LanguageModel:
        counts: dict[str, np.ndarray] = {}
        for lang, text in labelled:
            counts[lang] = counts.get(lang, 0) + np.bincount(cls.slots(text), minlength=SLOTS)
        return cls.of_counts(counts)

    @classmethod
    def of_counts(cls, by_name: dict[str, np.ndarray]) -> LanguageModel:
        names = sorted(by_name)
        counts = np.array([by_name[n] for n in names], np.float64).reshape(len(names), SLOTS)
        rate = (counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * SLOTS)
        return cls(names, np.ascontiguousarray(np.log(rate).T.astype(np.float32)))

    def sums(self, text: str) -> np.ndarray:
        return self.table.take(self.slots(text), 0).sum(0, dtype=np.float64)

    def scores(self, text: str) -> np.ndarray:
        """Log-likelihood of the text in each language, relative to the best."""
        found = self.sums(text)
        return found - found.max() if len(found) else found

    def language(self, text: str, margin: float = 8.0) -> str | None:
        """The language if it is ``margin`` nats likelier than the next."""
        if len(self.names) < 2 or len(text) < 3:
            return None
        s = self.sums(text).tolist()
        next_best, best = sorted(s)[-2:]
        return self.names[s.index(best)] if best - next_best >= margin else None


def fit_language_model(documents: DataFrame, labelled: int = LABELLED) -> LanguageModel:
    """Fitted on about ``labelled`` rows of (text, lang), at most twice as many: a share drawn by the hash of the id. Labelled
    texts teach whole; they are counted in the tasks, and a count a language and slot comes back. Rows without text or label are left out."""
    n = max(1, documents.count())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * labelled / n) + 1)
    rows = documents.where(share).where("text is not null and lang is not null and length(text) > 80").select(F.lower(F.trim("lang")).alias("lang"), "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                slot, times = np.unique(LanguageModel.slots(plain(text)), return_counts=True)
                yield pd.DataFrame({"lang": lang, "slot": slot, "n": times})

    counts: dict[str, np.ndarray] = {}
    for r in rows.limit(2 * labelled).mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).toLocalIterator():
        counts[r.lang] = np.bincount(r.slots, r.ns, SLOTS)
    return LanguageModel.of_counts(counts)


def _may(text: str, words: tuple[str, ...]) -> bool:
    """Whether a pattern each match of which holds one of the words may be found, which is told faster than by the pattern."""
    return any(map(text.lower().__contains__, words)) or not text.isascii() and any(map(text.__contains__, FOLDED))


def is_empty(text: str | None) -> bool:
    """Nothing that answers: NULL, blank, no letter or digit, a placeholder, a bare marker or label."""
    if text is None:
        return True
    text = plain(text)
    core = text.strip(" \t[](){}<>*_-–—.:;!?…\"'|#/\\=~").lower()
    if not any(c.isalnum() for c in core):
        return True
    if core in PLACEHOLDERS or re.fullmatch(r"[\w ]{1,20}:", text):
        return True
    return bool(re.fullmatch(r"(?:\[?excerpts? ?\d*\]?|\(?[0-9a-z][.)]|\[\d+\]|step \d+|#+ ?\w*)[\s.:]*", text, re.I))


def _tokens(text: str) -> list[str]:
    return _WORDS.findall(latin(plain(text)).lower())


def _fuzzy_start(a: str, b: str) -> bool:
    """Whether two texts share one of three short stretches of the first, blanks aside."""
    x, y = "".join(a.lower().split()), "".join(b.lower().split())
    return any(x[i : i + 7] in y for i in (0, len(x) // 3, 2 * len(x) // 3))


def is_copy(question: str | None, text: str) -> bool:
    """Only repeats the question, perhaps quoted, labelled, several times or slightly altered."""
    if not question:
        return False
    clean, question = plain(text), plain(question)
    for _ in range(4):
        shorter = clean
        for lead in (QUOTING, LABEL):
            if found := lead.match(shorter):
                shorter = shorter[found.end() :]
        shorter = shorter.strip()
        if shorter == clean:
            break
        clean = shorter
    asked = set(latin(question).lower().split())
    if len(clean) > 4 * len(question) + 200 and clean.isascii():
        said = clean.lower().split()
        if sum(map(asked.__contains__, said)) < 0.4 * len(said):
            return False
    if len(asked) > 3 and 3 * len(asked & set(latin(clean).lower().split())) < len(asked) and len(clean) > 40 and not _fuzzy_start(question, clean):
        return False
    q, a = _tokens(question), _tokens(clean)
    if not q or not a:
        return False
    cq, ca = Counter(q), Counter(a)
    times = max(1, round(len(a) / len(q)))
    for n in {times, times + 1} if times > 1 else {1, 2}:
        if abs(len(a) - n * len(q)) <= max(1, 0.3 * n * len(q)):
            common = sum(min(k * n, ca[w]) for w, k in cq.items())
            if common >= 0.85 * len(a) and common >= 0.7 * len(q) * n:
                return True
    if len(a) > 2 * len(q) + 4 or len(q) < 2 and len(a) > 3:
        return False
    x, y = "".join(q), "".join(a)
    if not 0.6 <= len(y) / len(x) <= 1.5 or min(len(x), len(y)) < 4:
        return False
    gx, gy = Counter(x[i : i + 3] for i in range(len(x) - 2)), Counter(y[i : i + 3] for i in range(len(y) - 2))
    return 2 * sum((gx & gy).values()) >= 0.8 * (sum(gx.values()) + sum(gy.values()))


def is_refusal(text: str) -> bool:
    """Every sentence declines or is small talk of at most ASIDE words, and at least one declines; what follows a declining clause in its
    sentence, after a word of contrast, is no more than small talk either and gives no number. The text's length doesn't matter."""
    declines, text = False, plain(text)
    if not _may(text, DECLINING_WORDS):
        return False
    for part in _SENTENCES.split(text):
        if found := DECLINES.search(part):
            rest = CONTRAST.search(part, found.end())
            after = part[rest.end() :] if rest else ""
            if after and not DECLINES.search(after) and (len(after.split()) > ASIDE or _SUBSTANCE.search(after)):
                return False
            if len(part.split()) > DECLINING:
                return False
            declines = True
        elif len(part.split()) > ASIDE or _SUBSTANCE.search(part):
            return False
    return declines


def language_defect(model: LanguageModel, question: str | None, text: str) -> bool:
    """Whether the answer, without what it quotes, is in another language than the question or than the question asks for."""
    if not question:
        return False
    body = _QUOTED.sub(" ", latin(plain(text)))
    if not _WORDS.search(body):
        return False
    want = _may(question, ASKED_WORDS) and next((k for k, v in _ASKED.items() if v.search(question)), None) or model.language(latin(plain(question)), 6.0)
    have = model.language(body)
    return bool(want and have and want != have)


def _uncited(text: str) -> str:
    return _CITED.sub("", text) if "[" in text else text


def _stream(text: str) -> list[tuple[bool, list[str]]]:
    """Lines of masked tokens, each with whether it is a list item; citations are left out."""
    out = []
    for line in _uncited(plain_lines(text)).split("\n"):
        words = line.split()
        if words:
            item = words[0] in "-*•" or bool(re.fullmatch(r"\d+[.)]", words[0]))
            out.append((item, words[1:] if item and len(words) > 1 else words))
    return out


def plain_lines(text: str) -> str:
    return "\n".join(map(lookalikes.plain, text.split("\n"))) if "\n" in text else plain(text)


@lru_cache(1 << 18)
def _mask(token: str) -> str:
    return re.sub(r"\d[\d.,e]*", "#", token.lower().strip("()[]\"'“”.,;:!?*"))


def _ends(token: str, after: str | None) -> bool:
    """Whether a sentence ends with the token."""
    if token[-1].isalnum() or not re.search(r"[.!?…][)\]\"'”»]*$", token) or token.lower().strip("()[]\"'") in ABBREVIATIONS:
        return False
    return after is None or not (after[0].islower() or after[0].isdigit())


def _contexts(item: bool, words: list[str]) -> list[str]:
    """The last one to LONGEST words, shortest first; a list's words are counted apart."""
    tag = "L|" if item else "S|"
    return [tag + " ".join(words[-n:]) for n in range(1, LONGEST + 1) if n <= len(words)]


def end_counts(text: str, seen: list[Counter], ends: list[Counter]) -> None:
    """Adds the text's contexts of each length: how often each occurs, and how often a sentence, or a line of a list, ends there."""
    lines = _stream(text)
    for k, (item, words) in enumerate(lines):
        masks = [_mask(w) for w in words]
        last_line = k + 1 == len(lines)
        if last_line and not words[-1][-1] in ".!?" and not re.search(r"[.!?]\W*$", words[-1]):
            masks.pop()  # what is to be judged teaches nothing
        if item:
            stops = [len(words)] if len(masks) == len(words) else []
        else:
            stops = [i + 1 for i, w in enumerate(words) if not w[-1].isalnum() and _ends(w, words[i + 1] if i + 1 < len(words) else None)]
        tag = "L|" if item else "S|"
        begin = 0
        for stop in [*stops, len(masks)]:
            run = ["^", *masks[begin:stop]]
            if len(run) > 1:
                seen[0].update(zip(repeat(tag), run[1:]))
                for n in range(1, LONGEST):
                    seen[n].update(zip(repeat(tag), *[run[j:] for j in range(n + 1)]))
                if stop in stops:
                    for n in range(min(LONGEST, len(run))):
                        if n or len(run) > 1:
                            ends[n][(tag, *run[len(run) - n - 1 :])] += 1
            begin = stop


def end_contexts(text: str) -> list[str] | str | None:
    """The last contexts of a text whose end is doubtful; "cut" if it shows a cut; None if it surely ends or is too short to tell."""
    clean = plain_lines(text).strip()
    if ("..." in clean or "…" in clean) and _ELLIPSIS.search(clean) and len(clean.split()) > 3:
        return "cut"
    body = _uncited(clean)
    for a, b in ("()", "[]"):
        if body.rfind(a) > body.rfind(b) and len(body) - body.rfind(a) < 80:
            return "cut"
    lines = _stream(body)
    if not lines:
        return None
    item, words = lines[-1]
    last = words[-1]
    if last[-1] in ",;:-–—‐(/" and sum(len(w) for _, w in lines) > 3:
        return "cut"
    if re.search(r"[.!?][)\]\"'”»]*$", last):
        if len(words) > 1 and last.lower().strip("()[]\"'") in ABBREVIATIONS or len(words) > 1 and re.fullmatch(r"[0-9]{1,2}\.", last) and (words[-2][-1] == ":" or _ends(words[-2], None)):
            return "cut"
        return None
    if sum(len(w) for _, w in lines) <= 3:
        return None
    before = []
    for i in range(len(words) - 1, -1, -1):
        before.append(_mask(words[i]))
        if len(before) == LONGEST:
            break
        if not i or not item and _ends(words[i - 1], words[i]):
            before.append("^")
            break
    return _contexts(item, before[::-1])


def _judge(model: LanguageModel, question: str | None, text: str | None) -> tuple[str, list[str] | None]:
    if is_empty(text):
        return "empty", None
    if is_copy(question, text):
        return "copy", None
    if is_refusal(text):
        return "refusal", None
    if language_defect(model, question, text):
        return "language", None
    found = end_contexts(text)
    return ("truncated", None) if found == "cut" else ("", found)


def defects(records: DataFrame, model: LanguageModel) -> DataFrame:
    """(record_kind, record_id, defect) of the unfit rows of (record_kind, record_id, question, text, at), one a record.

    Rules decide empty answers, copies and refusals; naive Bayes compares the languages; a text without a final mark is cut if the
    likelihood of an end after its last words, by counts over all texts, is low. The counts leave each task pre-aggregated and
    meet only the doubtful ends, in an equi-join. Of a record delivered more than once the latest counts. A NULL question
    leaves the rules on the answer alone; NULL ids drop out."""
    shared = records.sparkSession.sparkContext.broadcast((model.names, model.table))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            rows = [_judge(own, q, t) for q, t in zip(batch["question"], batch["text"])]
            out = pd.DataFrame(rows, columns=["defect", "ends"])
            yield pd.concat([batch[["record_kind", "record_id", "at"]].reset_index(drop=True), out], axis=1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, ends = [Counter() for _ in range(LONGEST)], [Counter() for _ in range(LONGEST)]

        def flush() -> pd.DataFrame:
            rows = [(k[0] + " ".join(k[1:]), n, e[k]) for c, e in zip(seen, ends) for k, n in c.items()]
            for c in (*seen, *ends):
                c.clear()
            return pd.DataFrame(rows, columns=["key", "n", "e"])

        for batch in batches:
            for t in batch["text"]:
                end_counts(t, seen, ends)
            if len(seen[-1]) > 200_000:
                yield flush()
        yield flush()

    rows = records.where("record_id is not null")
    judged = rows.mapInPandas(judge, "record_kind string, record_id bigint, at timestamp_ntz, defect string, ends array<string>")
    latest = judged.groupBy("record_kind", "record_id").agg(F.max_by(F.struct("defect", "ends"), F.struct("at", "defect")).alias("j")).select("record_kind", "record_id", "j.*")
    stats = rows.where("text is not null").select("text").mapInPandas(count, "key string, n long, e long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    sure = latest.where("defect <> ''").select("record_kind", "record_id", "defect")
    doubt = latest.where("defect = '' and ends is not null").select("record_kind", "record_id", F.posexplode("ends").alias("o", "key"))
    known = doubt.join(stats, "key", "left").groupBy("record_kind", "record_id").agg(*[F.coalesce(F.max(F.when(F.col("o") == o, F.col(c))), F.lit(0)).alias(f"{c}{o}") for o in range(LONGEST) for c in ("n", "e")], F.max(F.startswith("key", F.lit("L|"))).alias("item"))
    chance = F.when(F.col("item"), LIST_PRIOR).otherwise(PRIOR)
    for o in range(LONGEST):
        chance = (F.col(f"e{o}") + WEIGHT * chance) / (F.col(f"n{o}") + WEIGHT)
    return sure.unionByName(known.where(chance < ENDS).select("record_kind", "record_id", F.lit("truncated").alias("defect")))


def answer_records(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The question and answer pairs of both tables in one form."""
    a = turns.select(F.lit("turn").alias("record_kind"), F.col("turn_id").alias("record_id"), "question", F.col("answer").alias("text"), F.col("asked_at").alias("at"))
    b = answers.select(F.lit("answer").alias("record_kind"), F.col("answer_id").alias("record_id"), "question", "text", F.col("answered_at").alias("at"))
    return a.unionByName(b).withColumn("at", F.col("at").cast("timestamp_ntz"))
