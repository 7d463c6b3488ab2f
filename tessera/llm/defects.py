"""Problem 1: broken prompt and response pairs.

Pairs are neighbours in the order of a conversation. Messages are range-partitioned by conversation
and time, so a conversation with most of the rows is spread over many tasks; one pass pairs the
neighbours and judges them, and the rows at the partitions' ends are paired in a second, tiny pass.

* copy: the answer is compressed with zstandard, with the question as dictionary, and the question
  with the answer as dictionary; a copy leaves almost nothing to encode either way. Letters are spread
  to several bytes first, so that short texts too compress by what they share.
* refusal, empty, language: dictionaries.
* truncated: a terminal-context model. An answer ends in a context: an open fence, bracket or table
  row, a mark, a list item or a line with its last two words. Within all answers it is counted how
  often the text goes on in such a context and how often a line ends there; an answer is truncated if
  it ends where, by these counts and a weak prior, ending has a probability below ``LEAST_END``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.conversations import ASSISTANT, USER, turns
from tessera.session import parallelism, written

#: Bytes that a letter is spread to before compression, and where one of the texts has fewer than ``FEW_LETTERS``.
SPREAD, SPREAD_SHORT, FEW_LETTERS = 6, 16, 24
#: A copy leaves at most this share of the compressed answer, and of the question given the answer, to encode, or so few bytes.
COPY_SHARE, COPY_BACK, COPY_BYTES = 0.33, 0.2, 14
#: An answer is truncated if ending in its context is less probable than this.
LEAST_END = 0.01
#: Weight of the prior against one count.
PRIOR_WEIGHT = 0.02
#: Contexts to be judged are sent to all tasks if they are no more than this; else they are joined.
BROADCAST_CONTEXTS = 100_000

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were that with for on as by at from this which are has have had its it be or not an a all who what when how much did does about our their although while because after before during following under without within any why explain list which when please our they been will would should can into than then there being against between year last next each every",
    "fr": "le la les des du de et un une en est été a ont pour dans sur avec que qui ce cette au aux par sans pas plus l d s il elle nous vous ne se son sa ses leur mais ou où sont avait car après avant pendant selon tandis dont quel quelle notre à comme suite bien deux dernière restent puis tous toutes aucun aucune nos résume combien quand pourquoi chez nuit fin",
    "de": "der die das den dem des und ein eine einen einem einer ist war hat haben wurde mit für auf von zu im am an nicht auch nach bei aus vor wie über was wer wann viel ohne weil obwohl während aber oder zwar unser unsere alle noch sind wird zum zur danach zwei hat dass ihre ihr wenn warum welche welcher fasse nachdem innerhalb",
    "es": "el la los las de del y un una en es fue ha han para con que por se su sus al lo no como más pero o sin sobre cuando qué cuánto cuándo aunque antes después durante según mientras nuestro nuestra porque tras quedan todas todos resume por qué quién cuál dos hay este esta estos estas",
    "pt": "o a os as de do da dos das e um uma em no na nos nas é foi com que por para se seu sua ao à não como mais mas ou sem sobre quando embora antes depois durante segundo enquanto nosso nossa porque ainda haja todas todos pelo pela à às uns umas pelos pelas dois qual quem isto esta este foram",
    "it": "il lo la i gli le di del della dei delle e un una in è stato ha hanno con che per si suo sua al alla non come più ma o senza su quando anche dopo prima durante secondo mentre nostro nostra perché se restano tutte tutti nel nella entro da è degli agli sul sulla gli perché quale chi due nei nelle alcun alcuna senza entro dalla dal",
    "nl": "de het een en van in is was heeft hebben met voor op te dat die niet ook naar bij uit om zoals over wat wie wanneer hoeveel zonder omdat hoewel terwijl maar of onze alle nog er zijn wordt door aan tijdens binnen als volgens ter kort wij zij hun deze dit twee onze",
}
# Names of the languages, as a request for an answer uses them.
LANGUAGE_NAMES = {
    "en": "english anglais englisch englischer inglés ingles inglês inglese engels",
    "fr": "french français francais französisch franzosisch francés frances francês francese frans",
    "de": "german allemand deutsch deutscher alemán aleman alemão tedesco duits",
    "es": "spanish espagnol spanisch español espanol espanhol spagnolo spaans",
    "pt": "portuguese portugais portugiesisch portugués portugues português portoghese portugees",
    "it": "italian italien italienisch italiano italiaans",
    "nl": "dutch néerlandais neerlandais niederländisch niederlandisch neerlandés holandés holandês neerlandês olandese nederlands",
    "am": "amharic amharique amharisch amhárico amárico amarico amaarico amhaars",
}
# What a declined answer says; a pattern is tried only where one of its literal parts stands.
REFUSALS = [
    ("can't|cannot|cant|can not|won't|will not|able to|allowed to|permitted to|afraid i", r"\b(?:can(?:no|')?t|can not|won't|will not|(?:am|'m) (?:un|not )able to|unable to|not allowed to|not permitted to|(?:am|'m) afraid i can't) (?:be able to )?(?:help|assist|answer|comply|provide|discuss|respond|share|do that|fulfil|fulfill|complete (?:this|that) request|support)\b"),
    ("won't be", r"\bwon't be (?:able to (?:help|assist|answer|provide|discuss)|answering|discussing|helping)\b"),
    ("unable|not able", r"\b(?:i am|i'm) (?:unable|not able) to (?:comply|help|assist|answer|provide|discuss)\b"),
    ("against my|outside ", r"\bagainst my (?:guidelines|policy|policies|rules)\b|\boutside (?:of )?what i am allowed\b"),
    ("not something i", r"\bnot something i (?:can|could|am able to|may) (?:get into|discuss|talk about|help with|answer|comment on)\b"),
    ("rather not|prefer not", r"\b(?:would|'d|had) rather not (?:comment|say|answer|discuss|talk)\b|\bprefer not to (?:comment|say|answer|discuss)\b"),
    ("decline|no comment on", r"\b(?:must|have to|need to) decline\b|\bi decline\b|\bno comment on\b"),
    ("talk about something else|comfortable", r"\blet's talk about something else\b|\bdo not feel comfortable (?:answering|discussing|with)\b|\bdon't feel comfortable\b"),
    ("pas |impossible|préfère ne", r"\bne (?:peux|puis|pouvons|suis) pas (?:autorisée? à |en mesure de |vous )?(?:répondre|aider|fournir|commenter|discuter)\b|\bimpossible de (?:vous )?(?:aider|répondre)\b|\bpréfère ne pas (?:me prononcer|répondre|commenter|en parler)\b"),
    ("suis pas|je dois", r"\bne suis pas (?:autorisée?|habilitée?) à\b|\bje dois (?:décliner|refuser)\b"),
    ("nicht", r"\bdabei (?:kann|darf) ich (?:leider )?nicht helfen\b|\bkann ich (?:leider )?nicht (?:beantworten|helfen|sagen|weiterhelfen)\b|\bdarf ich (?:leider )?nicht (?:beantworten|sagen|besprechen)\b|\bmöchte ich mich nicht äußern\b|\bich (?:kann|darf|möchte) (?:dazu |diese (?:frage|anfrage) |ihnen |dir |dabei )?(?:leider )?nicht (?:beantworten|helfen|antworten|weiterhelfen|sagen)\b"),
    ("puedo|podemos|me está|me es|prefiero|debo ", r"\bno (?:puedo|podemos) (?:ayudar|responder|contestar|comentar|proporcionar)|\bno me (?:está|es) (?:permitido|posible) (?:responder|contestar|ayudar|hablar)|\bprefiero no (?:pronunciarme|responder|comentar|hablar)|\bdebo (?:negarme|declinar)"),
    ("não", r"\bnão posso (?:ajudar|responder|comentar|fornecer)|\bprefiro não (?:responder|comentar|me pronunciar)|\bnão (?:me é|estou) (?:permitido|autorizad[oa])"),
    ("non ", r"\bnon posso (?:aiutar|rispondere|commentare|fornire)|\bpreferisco non (?:rispondere|commentare|pronunciarmi)|\bnon mi è (?:permesso|consentito)"),
    ("niet|liever", r"\bkan (?:ik )?(?:u |je )?(?:daar |hier |daarbij |hierbij )?(?:helaas )?niet (?:mee |bij )?(?:helpen|beantwoorden|antwoorden)\b|\b(?:mag|wil) ik (?:helaas )?niet (?:beantwoorden|bespreken|zeggen)\b|\bliever niet\b"),
    ("ይቅርታ", r"ይቅርታ.*(?:አልችልም|አይቻለኝም|መርዳት አልችልም)"),
]
# Stand-ins for an answer that is not there.
STAND_INS = frozenset(
    "n/a|n.a.|na|none|null|nil|undefined|empty|nan|tbd|blank|no answer|no response|no reply|answer|response|reply|{}|[]|"
    "(none)|(empty)|(blank)|(null)|(no answer)|[none]|[empty]|[blank]|[null]|[no answer]|[no response]|<empty>|<none>|<null>|<blank>|<no answer>|"
    "keine antwort|sans réponse|sin respuesta|sem resposta|nessuna risposta|geen antwoord".split("|")
)

_VISIBLE = re.compile(r"[^\W_]")
_LONGEST = max(map(len, STAND_INS))
_CITATION = re.compile(r"\s*\[\d+(?:\s*,\s*\d+)*\]")
_REFUSALS = [(tuple(parts.split("|")), re.compile(pattern)) for parts, pattern in REFUSALS]
_FENCED = re.compile(r"(?s)```.*?(?:```|$)")
_ETHIOPIC = re.compile("[\u1200-\u137f]")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE_END = re.compile(r"[.!?。！？።፧‽][\"'»”’)\]*_`]*$")
_CLOSING = {")": "(", "]": "[", "}": "{"}
_LIST_LINE = re.compile(r"^\s*(?:[-*•+–]|\d+[.)]|[a-z][.)])\s+(.*)$", re.I)
_ASK = re.compile(r"(?i)\b(?:answer|reply|respond|translate|write|say|please|antwort\w*|übersetz\w*|schreib\w*|bitte|répond\w*|tradui\w*|écri\w*|respond\w*|contest\w*|traduc\w*|escrib\w*|respost\w*|traduz\w*|escrev\w*|rispond\w*|traduci\w*|scriv\w*|antwoord\w*|vertaal\w*|schrijf\w*)\b")
_NAMED = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_ASKED = re.compile(r"(?i)\b(?:in|into|to|en|auf|ins|em|para|al|naar|het|au)\s+(?:the\s+|het\s+|o\s+|l[’'])?(" + "|".join(sorted(_NAMED, key=len, reverse=True)) + r")\b")
_LEXICON = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_SPOKEN = {word: tuple(lang for lang in _LEXICON if word in _LEXICON[lang]) for lang in _LEXICON for word in _LEXICON[lang]}
# Endings and letters that few of the languages use.
_ENDINGS = [
    ("ciones", ("es",)), ("ción", ("es",)), ("ções", ("pt",)), ("ção", ("pt",)), ("zione", ("it",)), ("zioni", ("it",)), ("mente", ("es", "pt", "it")),
    ("ungen", ("de",)), ("ung", ("de",)), ("keit", ("de",)), ("heid", ("nl",)), ("ingen", ("nl",)), ("aient", ("fr",)), ("eux", ("fr",)), ("eur", ("fr",)),
    ("ing", ("en",)), ("ness", ("en",)), *((f"{c}ed", ("en",)) for c in "bcdfghjklmnpqrstvwxyz"), ("ías", ("es",)), ("ía", ("es",)), ("ó", ("es",)), ("ou", ("pt",)), ("ato", ("it",)), ("ito", ("it",)), ("uto", ("it",)),
    ("ado", ("es", "pt")), ("ados", ("es", "pt")), ("lijk", ("nl",)), ("lijke", ("nl",)), ("és", ("fr",)), ("ée", ("fr",)),
]
_LETTERS = {"¿": ("es",), "¡": ("es",), "ñ": ("es",), "ß": ("de",), "ã": ("pt",), "õ": ("pt",), "ä": ("de",), "ö": ("de",), "œ": ("fr",), "ê": ("fr", "pt"), "ç": ("fr", "pt"), "ù": ("fr", "it"), "ò": ("it",), "ì": ("it",)}


@lru_cache(maxsize=16)
def plain(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("’", "'").replace("‘", "'").lower()


@lru_cache(maxsize=200_000)
def _signs(word: str) -> tuple[str, ...]:
    """The languages that a word speaks for."""
    spoken = _SPOKEN.get(word)
    return next((langs for ending, langs in _ENDINGS if len(word) > len(ending) + 1 and word.endswith(ending)), ()) if spoken is None else spoken


def language_of(text: str, least: float = 1.0) -> str | None:
    """Language by function words, word endings and letters, or None if they speak too softly or for two languages.

    A sign counts 1 divided by the number of languages that share it.
    """
    if not text:
        return None
    text = _FENCED.sub(" ", text)
    if _ETHIOPIC.search(text):
        ethiopic = len(_ETHIOPIC.findall(text))
        if ethiopic * 2 > sum(c.isalpha() for c in text):
            return "am" if ethiopic >= 4 else None
    scores = dict.fromkeys(_LEXICON, 0.0)
    for word in (p for w in _WORD.findall(plain(text)) for p in w.split("'")):
        for lang in (spoken := _signs(word)):
            scores[lang] += 1 / len(spoken)
    for letter, langs in _LETTERS.items():
        if letter in text:
            for lang in langs:
                scores[lang] += 1 / len(langs)
    best, second = sorted(scores, key=scores.get, reverse=True)[:2]
    return best if scores[best] >= least and scores[best] >= 1.4 * scores[second] else None


def asked_language(question: str) -> str | None:
    """The language that a question asks the answer to be in."""
    for sentence in re.split(r"(?<=[.!?:\n])\s+", question):
        named = _ASKED.search(sentence)
        if named and _ASK.search(sentence):
            return _NAMED[named.group(1).lower()]
    return None


@lru_cache(maxsize=8_192)
def _code(letter: str, size: int) -> bytes:
    return xxhash.xxh3_128_digest(letter.encode("utf-8", "surrogatepass"))[:size]


@lru_cache(maxsize=64)
def _options(log: int) -> tuple[zstandard.ZstdCompressionParameters, zstandard.ZstdCompressor, int]:
    """Parameters for texts of up to ``2 ** log`` bytes, a compressor without dictionary, and what it makes of nothing."""
    options = zstandard.ZstdCompressionParameters(
        window_log=max(10, log), hash_log=max(7, min(log, 22)), chain_log=max(7, min(log, 22)), search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    plain_compressor = zstandard.ZstdCompressor(compression_params=options)
    return options, plain_compressor, len(plain_compressor.compress(b""))


def residual(prompt: bytes, data: bytes) -> tuple[int, int]:
    """Compressed bytes of ``data`` with and without ``prompt`` as zstandard dictionary, without frame overhead."""
    options, alone, base = _options(min(27, (len(prompt) + len(data)).bit_length()))
    given = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    with_prompt = zstandard.ZstdCompressor(compression_params=options, dict_data=given)
    return len(with_prompt.compress(data)) - base, len(alone.compress(data)) - base


def _letters(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def is_copy(question: str, answer: str) -> bool:
    """The answer gives back the question, perhaps lightly altered or several times, and nothing more.

    Decided by compression alone. Two texts whose distinct words have less than a quarter of their letters
    in common leave more to encode than a copy may, so they are not compressed.
    """
    q, a = _letters(question), _letters(_CITATION.sub(" ", answer))
    if not q or not a:
        return False
    asked, said = set(q), set(a)
    if len(said) > 3 and len(asked) > 3:
        common = sum(map(len, asked & said))
        if common * 4 < min(sum(map(len, asked)), sum(map(len, said))):
            return False
    q, a = " ".join(q), " ".join(a)
    size = SPREAD_SHORT if min(len(q), len(a)) < FEW_LETTERS else SPREAD
    prompt, data = (b"".join(_code(c, size) for c in text) for text in (q, a))
    left, alone = residual(prompt, data)
    if left > max(COPY_BYTES, COPY_SHARE * alone):
        return False
    back, alone = residual(data, prompt)
    return back <= max(COPY_BYTES, COPY_BACK * alone)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    rest = _CITATION.sub(" ", answer)
    if len(_VISIBLE.findall(rest)) > _LONGEST:
        return False  # letters or figures, and more of them than any stand-in has
    text = "".join(c for c in rest if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc")).lower()
    spaced = " ".join(plain(rest).split()).strip()
    return not any(c.isalnum() for c in text) or text in STAND_INS or spaced in STAND_INS or spaced.rstrip(".:") in STAND_INS


def _declines(text: str) -> bool:
    return any(any(p in text for p in parts) and pattern.search(text) for parts, pattern in _REFUSALS)


def is_refusal(answer: str) -> bool:
    """Declines in at least half of what it says, or in any of it if that is short; other text may be an answer besides."""
    text = " ".join(plain(_CITATION.sub(" ", answer)).split())
    if len(text) <= 400 or not _declines(text):
        return _declines(text)
    sentences = [s for s in re.split(r"(?<=[.!?።])\s+", text) if s]
    return 2 * sum(len(s) for s in sentences if _declines(s)) >= len(text)


def _masked(word: str) -> str:
    return word if word.isalpha() else _DIGITS.sub("0", word)


def context_key(words: list[str]) -> str:
    """The last two words, digits masked."""
    return " ".join(_masked(w) for w in ["<s>", *words][-2:])


def _table_cut(lines: list[str]) -> bool:
    """The last lines are a table that does not end with a full row."""
    rows = [x.strip() for x in lines]
    first = len(rows) - 1
    while first > 0 and rows[first - 1].startswith("|"):
        first -= 1
    table = rows[first:]
    if len(table) < 3:
        return True  # a heading without a row
    cells = table[0].count("|")
    return not table[-1].endswith("|") or table[-1].count("|") != cells or set(table[-1]) <= set("|-: ")


def _open_brackets(text: str) -> bool:
    stack = []
    for i, c in enumerate(text):
        if c in "([{":
            stack.append(c)
        elif c in _CLOSING:
            if stack and stack[-1] == _CLOSING[c]:
                stack.pop()
    return bool(stack)


#: Contexts an answer may end in, and how probable it is beforehand that a text is complete there.
CONTEXTS = {
    "stop": 0.99, "block": 0.99, "row": 0.99, "name": 0.99, "short": 0.5,
    "fence": 0.005, "part of a row": 0.005, "bracket": 0.005, "ellipsis": 0.005, "mark": 0.005, "number": 0.005, "line": 0.005, "unlike": 0.005, "item": 0.005, "start": 0.005, "word": 0.005,
}


def terminal_context(answer: str) -> tuple[str, str]:
    """(kind, context) in which the answer ends; for items and short lines the context is the last two words, else it is the kind."""

    def of(kind: str, words: list[str] | None = None) -> tuple[str, str]:
        return kind, context_key(words) if words else f"#{kind}"

    text = answer.strip()
    if text.count("```") % 2:
        return of("fence")
    if text.endswith("```"):
        return of("block")
    lines = text.split("\n")
    if lines[-1].lstrip().startswith("|"):
        return of("part of a row" if _table_cut(lines) else "row")
    body = _CITATION.sub("", text).rstrip()
    if _open_brackets(re.sub(r"(?s)```.*?```", " ", _LIST_MARK.sub("", body))):
        return of("bracket")
    if not body:
        return of("stop")
    last_line = body.split("\n")[-1]
    if body.endswith(("…", "...")):
        return of("ellipsis")
    item = _LIST_LINE.match(last_line)
    if _SENTENCE_END.search(body):
        return of("number" if item is None and _BARE_NUMBER.fullmatch(last_line) else "stop")
    if body[-1] in _MARKS:
        return of("mark")
    if item:
        # where the items before end with a full stop, so must the last
        others = [m.group(1).rstrip() for m in map(_LIST_LINE.match, body.split("\n")[:-1]) if m]
        if others and all(_SENTENCE_END.search(_CITATION.sub("", o).rstrip()) for o in others):
            return of("unlike")
        words = _WORD.findall(plain(item.group(1)))
        return of("item", words) if words else of("mark")
    words = _WORD.findall(plain(last_line))
    if len(_WORD.findall(body)) > 6 or "\n" in body.strip():
        return of("line")
    if len(words) < 2:
        return of("word" if words and words[0] in _SPOKEN and words[0] not in _YES_NO else "name")
    # four or more words without a figure look like the start of a sentence
    return of("start" if len(words) > 3 and all(w.isalpha() for w in words[-3:]) else "short", words)


_YES_NO = frozenset("no non nein não nee all alle none todos todas tous toutes".split())
_LIST_MARK = re.compile(r"(?m)^\s*(?:\d+|[a-zA-Z])\)\s")
_BARE_NUMBER = re.compile(r"\s*\d+[.)]")
_MARKS = ",;:-–—/("


def judge(question: str | None, answer: str | None) -> tuple[str | None, str | None, str | None]:
    """(defect, context that decides whether the answer is truncated, kind of the context); without context the defect is sure."""
    if is_empty(answer):
        return "empty", None, None
    question = question or ""
    bare = _CITATION.sub(" ", answer)
    if is_copy(question, bare):
        return "copy", None, None
    if is_refusal(bare):
        return "refusal", None, None
    kind, context = terminal_context(answer)
    wanted = asked_language(question) or language_of(question)
    if wanted:
        got = language_of(bare, 1.5)
        if got and got != wanted:
            return "language", context, kind
    return None, context, kind


_PAIR = "kind string, part int, question_id long, answer_id long, defect string, context string, line string, conversation_id long, message_id long, speaker int, content string"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judged pairs of neighbours within the partition, and its first and last row."""
    last = None
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for part, conversation, message, who, content in zip(*columns):
            row = (part, conversation, message, who, content)
            if last is None:
                out.append(("first", part, None, None, None, None, None, conversation, message, who, content))
            elif last[1] == conversation and last[3] == USER and who == ASSISTANT:
                out.append(("pair", part, last[2], message, *judge(last[4], content), None, None, None, None))
            last = row
        if out:
            yield _pair_batch(out)
    if last is not None:
        yield _pair_batch([("last", last[0], None, None, None, None, None, *last[1:])])


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in _PAIR.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _judge_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [judge(q, a) for q, a in zip(b.question.astype(object).where(b.question.notna(), None), b.answer.astype(object).where(b.answer.notna(), None))]
        yield pd.DataFrame({"question_id": b.question_id, "answer_id": b.answer_id, "defect": [f[0] for f in found], "context": [f[1] for f in found], "line": [f[2] for f in found]})


def _count(text: str, ends: Counter, inside: Counter, wanted: frozenset[str] | None, last: frozenset[str] | None) -> None:
    """Add what the lines of one answer, but for the last, say about contexts; ``wanted`` None stands for all."""
    lines = plain(_CITATION.sub("", text)).split("\n")
    fenced, cells = False, 0
    for i, line in enumerate(lines):
        more, bare = i < len(lines) - 1, line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            inside["#fence"] += more
            continue
        if bare.startswith("|"):
            cells = cells or bare.count("|")
            full = bare.endswith("|") and bare.count("|") == cells and not set(bare) <= set("|-: ")
            (ends if full else inside)["#row" if full else "#part of a row"] += more
            continue
        cells = 0
        item = _LIST_LINE.match(line)
        words = [_masked(w) for w in _WORD.findall(item.group(1) if item else line)]
        pairs = list(zip(["<s>", *words], words))
        for a, b in pairs[:-1]:
            if last is None or b in last:
                key = f"{a} {b}"
                if wanted is None or key in wanted:
                    inside[key] += 1
        inside["#line"] += max(0, len(words) - 7)
        if not more or not bare:
            continue
        if _SENTENCE_END.search(bare):
            if _BARE_NUMBER.fullmatch(bare):
                inside["#number"] += 1
            else:
                ends["#stop"] += 1
        elif bare[-1] in _MARKS:
            inside["#mark"] += 1
        elif _open_brackets(_LIST_MARK.sub("", bare)):
            inside["#bracket"] += 1
        elif item and words:
            key = " ".join(pairs[-1])
            if wanted is None or key in wanted:
                ends[key] += 1


def _contexts(wanted: frozenset[str] | None):
    last = None if wanted is None else frozenset(w.split(" ")[-1] for w in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often a text goes on in a context, and how often a line ends there and others follow."""
        for batch in batches:
            ends: Counter = Counter()
            inside: Counter = Counter()
            for text in batch.column(0).to_pylist():
                _count(text, ends, inside, wanted, last)
            keys = list(inside.keys() | ends.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], names=["context", "goes_on", "ends"])

    return run


def broken_pairs(messages: DataFrame) -> DataFrame:
    """``(question_id, answer_id, defect)`` for every defective pair of a question and the answer right after it.

    Defects: empty, copy, refusal, truncated, language; the first that holds, in this order. Rows without
    conversation or time, and system and tool rows, take no part; repeated rows count once. A null or
    empty question has no language and cannot be copied. An empty table gives no rows.
    """
    spark = messages.sparkSession
    rows = turns(messages).filter("created_at is not null")
    rows = rows.groupBy("conversation_id", "speaker", "created_at", "content").agg(F.min("message_id").alias("message_id"))
    order = ["conversation_id", "created_at", "speaker", "message_id"]
    ordered = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    judged = ordered.select(F.spark_partition_id().alias("part"), "conversation_id", "message_id", "speaker", "content").mapInArrow(_pairs, _PAIR)
    judged = written(judged, "judged")

    # the last row of a partition and the first of the next; two rows a partition, without their texts
    by_part = Window.orderBy("part", F.when(F.col("kind") == "first", 0).otherwise(1))
    names = ["kind", "part", "conversation_id", "message_id", "speaker"]
    ends = judged.filter("kind != 'pair'").select(*names, *(F.lead(c).over(by_part).alias(f"next_{c}") for c in names))
    across = ends.filter((F.col("kind") == "last") & (F.col("next_kind") == "first") & (F.col("conversation_id") == F.col("next_conversation_id")) & (F.col("speaker") == USER) & (F.col("next_speaker") == ASSISTANT))
    texts = judged.filter("kind != 'pair'")
    across = across.select("part", "next_part", F.col("message_id").alias("question_id"), F.col("next_message_id").alias("answer_id"))
    across = across.join(texts.filter("kind = 'last'").select("part", F.col("content").alias("question")), "part").join(texts.filter("kind = 'first'").select(F.col("part").alias("next_part"), F.col("content").alias("answer")), "next_part")
    across = across.mapInPandas(_judge_ends, "question_id long, answer_id long, defect string, context string, line string")
    pairs = judged.filter("kind = 'pair'").select("question_id", "answer_id", "defect", "context", "line").unionByName(across)
    sure = pairs.filter("context is null and defect is not null").select("question_id", "answer_id", "defect")

    ending = pairs.filter("context is not null")
    asked = ending.select("context").distinct()
    few = asked.limit(BROADCAST_CONTEXTS + 1).collect()  # bounded by the parameter; a limit only to see whether it is exceeded
    wanted = frozenset(r.context for r in few) if len(few) <= BROADCAST_CONTEXTS else None
    answers = turns(messages).filter((F.col("speaker") == ASSISTANT) & F.col("content").isNotNull()).select("content")
    model = answers.mapInArrow(_contexts(wanted), "context string, goes_on long, ends long")
    model = model.join(asked, "context", "left_semi").groupBy("context").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    seen = ending.join(model, "context", "left").withColumns({"goes_on": F.coalesce("goes_on", F.lit(0)), "ends": F.coalesce("ends", F.lit(0))})
    prior = F.element_at(F.create_map(*(F.lit(x) for pair in CONTEXTS.items() for x in pair)), F.col("line"))
    probability = (F.col("ends") + PRIOR_WEIGHT * prior) / (F.col("ends") + F.col("goes_on") + PRIOR_WEIGHT)
    decided = seen.withColumn("defect", F.when(probability < LEAST_END, "truncated").otherwise(F.col("defect"))).filter("defect is not null").select("question_id", "answer_id", "defect")
    return sure.unionByName(decided)
