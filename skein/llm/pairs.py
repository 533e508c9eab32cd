"""Defective question-answer pairs: refusal, empty, truncated, copy and language, at most one of them a pair.

The copied part of an answer is measured by traversing a suffix automaton of the question; refusals are found by an
Aho-Corasick automaton over phrases, cut-off answers by a stack of delimiters and by how they end, foreign answers by
votes of scripts and stopwords. A mark that stays open tells of a cut only where the text also stops without an end.

Defined results: a null, blank, invisible or placeholder answer is ``empty`` whatever else the row holds, unless the
error says that the model or provider declined (``refusal``); a null or blank question leaves copy and language out;
rows without an id are left out; of several rows of one id the first defect in the order of ``DEFECTS`` counts; texts
of any length are read whole, and the automaton of a question takes some 300 bytes a character while its pair is judged. Only the named columns are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import spread

DEFECTS = ("refusal", "empty", "truncated", "copy", "language")

#: Fields of a stored answer that hold counters and no text.
COUNTERS = frozenset({"inputTokens", "outputTokens", "totalTokens", "tokens", "chunks"})
#: Fields that hold the question.
QUESTION_FIELDS = ("input", "user_input", "question", "prompt", "text", "query")
#: Answers that only stand for a missing one, without punctuation and in lower case.
PLACEHOLDERS = frozenset("null none nil na n/a nan undefined empty tbd todo 无 空 暂无 没有 无内容 なし".split())

#: Words of refusals; phrases are every combination of an inability and an act. In English the sentence must also be in the first person.
UNABLE_EN = ("can't", "cannot", "can not", "unable to", "not able to", "won't be able to", "will not be able to", "won't", "will not", "must not", "would rather not", "prefer not to", "not possible for me to", "not allowed to", "not permitted to", "do not let me", "don't let me", "not comfortable", "don't have the ability to", "do not have the ability to", "lack the ability to", "not in a position to")
ACTS_EN = ("help", "assist", "provide", "produce", "create", "write", "discuss", "discussing", "answer", "comply", "fulfil", "fulfill", "process", "generate", "support", "cover", "share", "complete", "respond", "talk about", "do that", "do this", "do so", "offer", "engage", "carry out", "accommodate")
FIRST_PERSON = re.compile(r"\b(?:i|i'm|i'd|i'll|we|we're|me|my|our|us)\b")
UNABLE_ZH = ("无法", "不能", "没办法", "没法", "不方便", "不便", "不可以", "拒绝", "没有能力")
ACTS_ZH = ("提供", "讨论", "写", "生成", "回答", "处理", "完成", "满足", "协助", "帮助", "帮你", "帮您", "为你", "为您", "创作", "给出", "继续", "支持", "执行", "谈论", "输出", "答复", "帮到", "照办", "做到这")
#: Whole phrases of refusals, in every language with a list of stopwords and some more.
REFUSALS = (
    "have to decline", "must decline", "request declined", "i decline", "i refuse", "outside what i", "beyond what i", "must leave to", "let's talk about something else", "against my guidelines", "against our guidelines", "against my policy", "against our policy", "against our policies", "violates our", "violates my", "not something i can",
    "超出了我", "换个问题", "换一个吧", "换个话题", "做不到这", "恕难", "恕我不能", "恕不", "爱莫能助", "违反了我们的", "不符合我们的",
    "no puedo ayudar", "no puedo responder", "no puedo hacer eso", "no me es posible", "no estoy en condiciones de",
    "je ne peux pas répondre", "je ne peux pas vous aider", "je ne peux pas t'aider", "je ne peux pas faire", "je ne peux pas fournir", "je ne peux pas traiter", "je ne suis pas en mesure de", "il m'est impossible de",
    "ich kann dabei nicht helfen", "kann ich nicht beantworten", "kann ich leider nicht", "ich kann ihnen nicht", "ich kann dir nicht", "ich kann diese anfrage nicht", "bin nicht in der lage",
    "não posso ajudar", "não posso responder", "não posso fazer isso", "não consigo ajudar", "não me é possível",
    "non posso aiutar", "non posso rispondere", "non posso farlo", "non sono in grado di", "non mi è possibile",
    "お答えできません", "お手伝いできません", "お応えできません", "対応できません", "提供できません", "お断りします",
    "답변할 수 없", "도와드릴 수 없", "도움을 드릴 수 없", "не могу помочь", "не могу ответить", "не могу выполнить",
)
REFUSED_ERRORS = ("content_filter", "content filter", "拒绝回答", "审核未通过", "safety system", "declined the request", "content policy", "blocked by content", "model refused", "provider refused")
CUT_ERRORS = ("partial answer", "已截断", "截断", "finish_reason=length", "stream closed", "max_tokens", "truncated", "输出达到上限")

#: Share of an answer that must decline for the whole to count as a refusal, without quotations.
REFUSED_SHARE = 0.5
#: Share of the question that one copied run must cover, and of the answer that copied runs must cover.
COPIED_QUESTION, COPIED_ANSWER = 0.8, 0.9
#: Words around a copied question that only label it.
LABELS = frozenset("question prompt query input you asked your is was the q a user says repeat echo answer reply response output result 问题 问 提问 题目 你的 您的 你问 输入 是 原问题 用户 用户问 回答 答 答案 回复 输出 结果".split())
#: A label at the begin of a line or a sentence: a few words and a colon, or something in brackets or marks of emphasis.
LABEL = re.compile(r"(?:^|[\n.。!！?？])[\s>#*_\"“-]*[^\s:：.。!！?？,，;；][^:：.。!！?？,，;；\n]{0,23}[:：]|\[[^\]\n]{1,24}\]|\*\*[^*\n]{1,24}\*\*")

#: Words in a last line after which no text ends.
DANGLING_EN = frozenset("the a an of to and or with for in on at by from that than is are was its as but when if until before after because so whether which while into their this these".split())
END_MARKS = re.compile(r"(?:\n|^)[\s(（\[【*—-]*(?:end of script|the end|end|fin|完|全文完|完结)[\s)）\]】*.。—-]*$", re.IGNORECASE)
#: Characters that can end a whole text.
TERMINAL = frozenset(".。!！?？…~～;；")
CLOSERS = {"”": "“", "’": "‘", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "}": "{", "】": "【", "》": "《"}
OPENERS = frozenset(x for x in CLOSERS.values() if x != "‘")
LIST_ITEM = re.compile(r"^\s*(?:[-*•·+]|\(?\d+[.)、．]|[一二三四五六七八九十]+、)\s*")
#: A line with nothing but the mark of a list item, a heading, a quotation or a label.
BARE_MARK = re.compile(r"^\s*(?:[-*•·+#>|]+|\(?\d+[.)、．]|[一二三四五六七八九十]+、|[^\s:：]{1,12}[:：])\s*$")
SENTENCE = re.compile(r"[^.。!！?？\n]*[.。!！?？\n]*")
QUOTED = re.compile(r"“[^”]*”|「[^」]*」|『[^』]*』|\"[^\"\n]*\"")
#: A short answer without any end mark inside, such as a title: up to so many words or wide characters.
TITLE_WORDS, TITLE_WIDE = 9, 16

STOPWORDS = {
    "en": frozenset("the and is of to in it that when with for this are not but how from then what between every only before after there which now you your a an on about one please write draft why should be so than two three at by me i or as if no all we us can may give need first".split()),
    "es": frozenset("el la los las de del que y en un una es por con para antes primero entre quedan conviene cuando más como se al lo hay sus a no me si o su esta este sin sobre".split()),
    "fr": frozenset("le la les des et est dans une un pour que qui avec pas sur ce cette avant après il elle nous vous du au à en se si ou par sans entre".split()),
    "de": frozenset("der die das und ist nicht ein eine zu den von mit für auf dem sich auch wenn aber nach vor wird oder zuerst danach im am es wie in an".split()),
    "pt": frozenset("o os a as do da dos das que em um uma é por com para não mais como se ao antes entre quando no na".split()),
    "it": frozenset("il lo gli di che è un una per con non del della prima dopo quando sono nel alla tra".split()),
}
#: The languages of each stopword.
SPEAKERS = {word: tuple(name for name, known in STOPWORDS.items() if word in known) for known in STOPWORDS.values() for word in known}
#: Names of languages in questions that ask for an answer in them.
NAMED = {
    "en": ("english", "英文", "英语", "英語", "inglés"),
    "zh": ("chinese", "mandarin", "中文", "汉语", "chino", "中国語"),
    "ja": ("japanese", "日文", "日语", "日語", "japonés", "日本語"),
    "es": ("spanish", "西班牙", "español", "スペイン語"),
    "fr": ("french", "法文", "法语", "francés", "フランス語"),
    "de": ("german", "德文", "德语", "alemán", "ドイツ語"),
    "pt": ("portuguese", "葡萄牙", "portugués"),
    "it": ("italian", "意大利", "italiano"),
    "ko": ("korean", "韩文", "韩语", "韓国語"),
    "ru": ("russian", "俄文", "俄语"),
    "ar": ("arabic", "阿拉伯"),
    "el": ("greek", "希腊"),
    "he": ("hebrew", "希伯来"),
    "hi": ("hindi", "印地语"),
    "th": ("thai", "泰文", "泰语"),
}
#: A wide character says as much as so many letters of an alphabet.
WIDE_WEIGHT = 2.5

WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
NOT_ALNUM = re.compile(r"[\W_]+", re.UNICODE)
HAN, KANA, HANGUL = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]+"), re.compile(r"[\u3040-\u30ff]+"), re.compile(r"[\uac00-\ud7af]+")
CYRILLIC, LATIN = re.compile(r"[\u0400-\u04ff]+"), re.compile(r"[A-Za-z\u00c0-\u024f]+")
#: Other scripts, by the language that most texts in them are in.
SCRIPTS = {name: regex.compile(rf"\p{{Script={script}}}") for name, script in (("ar", "Arabic"), ("el", "Greek"), ("he", "Hebrew"), ("hi", "Devanagari"), ("th", "Thai"), ("bn", "Bengali"), ("ta", "Tamil"), ("te", "Telugu"), ("ka", "Georgian"), ("hy", "Armenian"), ("am", "Ethiopic"), ("km", "Khmer"), ("my", "Myanmar"), ("lo", "Lao"), ("si", "Sinhala"), ("gu", "Gujarati"), ("pa", "Gurmukhi"), ("kn", "Kannada"), ("ml", "Malayalam"), ("bo", "Tibetan"))}
WORD_MARKS = regex.compile(r"[\p{L}\p{M}]")
#: Code, paths, addresses and file names, which are in no language.
CODE = re.compile(r"```.*?(?:```|$)|[\w.:-]*[/\\][\w./\\-]+|\b[\w-]+\.[A-Za-z]\w{1,3}\b", re.DOTALL | re.ASCII)
VISIBLE = re.compile(r"[^\W_]", re.UNICODE)
DELIMITER = re.compile(r"[“”「」『』（）()\[\]{}【】《》\"]")
ENDED = re.compile(r"[。！？]|[.!?](?:\s|$)")


def _count(pattern: re.Pattern[str], text: str) -> int:
    return len(text) - len(pattern.sub("", text))


@lru_cache(maxsize=8)  # the steps of one pair ask for the same texts
def _plain(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'").lower()


class SuffixAutomaton:
    """All substrings of a text; ``matches`` gives at each position of another text the longest one that ends there."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for char in text:
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            at = last
            while at != -1 and char not in self.next[at]:
                self.next[at][char] = state
                at = self.link[at]
            if at != -1:
                old = self.next[at][char]
                if self.length[at] + 1 == self.length[old]:
                    self.link[state] = old
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[old]))
                    self.length.append(self.length[at] + 1)
                    self.link.append(self.link[old])
                    while at != -1 and self.next[at].get(char) == old:
                        self.next[at][char] = copy
                        at = self.link[at]
                    self.link[old] = self.link[state] = copy
            last = state

    def matches(self, text: str) -> list[int]:
        state, size, out = 0, 0, []
        for char in text:
            while state and char not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if char in self.next[state]:
                state, size = self.next[state][char], size + 1
            out.append(size)
        return out

    def copied(self, text: str, least: int) -> tuple[int, int]:
        """Characters of ``text`` in copied runs of at least ``least``, and the longest run."""
        sizes = self.matches(text)
        covered, until, longest = 0, len(text), 0
        for end in range(len(text) - 1, -1, -1):
            if sizes[end] >= least:
                longest = max(longest, sizes[end])
                start = end - sizes[end] + 1
                if start < until:
                    covered += min(until, end + 1) - start
                    until = start
        return covered, longest


@lru_cache(maxsize=1)
def _refusals() -> Any:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in (*REFUSALS, *(a + b for a in UNABLE_ZH for b in ACTS_ZH)):
        machine.add_word(phrase, False)
    for phrase in (f"{a} {b}" for a in UNABLE_EN for b in ACTS_EN):
        machine.add_word(phrase, True)  # only in the first person
    machine.make_automaton()
    return machine


def is_refusal(answer: str) -> bool:
    """Whether the answer as a whole declines: sentences with a refusal are at least half of what is not quoted."""
    machine = _refusals()
    text = _plain(answer)
    if next(machine.iter(text), None) is None:
        return False
    bare = QUOTED.sub(" ", text)
    if len(NOT_ALNUM.sub("", bare)) < 4:
        bare = text
    total = declined = 0
    for sentence in SENTENCE.findall(bare):
        size = len(NOT_ALNUM.sub("", sentence))
        total += size
        if size and any(not english or FIRST_PERSON.search(sentence) for _, english in machine.iter(sentence)):
            declined += size
    return total > 0 and declined >= REFUSED_SHARE * total


def is_empty(answer: str) -> bool:
    """Nothing but blanks, invisible characters or punctuation, or a mere placeholder."""
    if len(answer) > 24 and VISIBLE.search(answer):
        return False
    seen = "".join(x for x in answer if unicodedata.category(x)[0] not in "ZC")
    bare = NOT_ALNUM.sub("", seen)
    return not bare and not any(unicodedata.category(x) == "So" for x in seen) or seen.strip("()[]<>\"'`.-–—*：:。").lower() in PLACEHOLDERS


def _open(text: str) -> bool:
    """Whether a bracket or quotation mark stays open at the end."""
    stack: list[str] = []
    straight = False
    for char in DELIMITER.findall(text):
        if char in OPENERS:
            stack.append(char)
        elif char == '"':
            straight = not straight
        elif stack and stack[-1] == CLOSERS[char]:
            stack.pop()
    return bool(stack) or straight


def is_json(text: str) -> bool:
    """Whether the text is a whole JSON object or list."""
    if text.lstrip()[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def is_cut(answer: str) -> bool:
    """Whether the text stops before its end."""
    text = answer.rstrip()
    marked = END_MARKS.search(text)
    if marked and marked.start() > 0:
        return bool(text.count("```") % 2)
    if is_json(text):
        return False
    last = text[-1]
    if text.count("```") % 2 or last not in TERMINAL and _open(text):  # in a text that ends properly an unclosed mark is a slip
        return True
    if "\n" in text and BARE_MARK.match(text[text.rindex("\n") + 1 :]):
        return True
    if last in TERMINAL or last in CLOSERS or last in "\"'`*_|>" or unicodedata.category(last) == "So":
        return False
    if last in ",，、:：(（-—" and len(text) > 1:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    line = lines[-1]
    wide = _count(HAN, line) + _count(KANA, line)
    words = line.split()
    if words[-1].lower() in DANGLING_EN and len(words) > 1:
        return True
    items = [x for x in lines if LIST_ITEM.match(x)]
    if LIST_ITEM.match(line) and (len(items) == 1 or any(x.rstrip()[-1] not in TERMINAL for x in items[:-1])):
        return False
    if len(words) == 1 and not wide:
        return False
    if not ENDED.search(text) and len(lines) == 1 and (wide <= TITLE_WIDE if wide else len(words) <= TITLE_WORDS):
        return False
    return True


def language(text: str) -> tuple[str, float]:
    """Language by the votes of scripts and, among Latin ones, of stopwords, with the weight of the evidence; '' if none."""
    text = CODE.sub(" ", text)
    votes = {"latin": float(_count(LATIN, text))}
    if not text.isascii():
        kana, han = _count(KANA, text), _count(HAN, text)
        votes |= {"zh" if kana * 12 < han else "ja": (han + kana) * WIDE_WEIGHT}
        if han + kana + votes["latin"] < len(text) / 4:
            votes |= {"ko": _count(HANGUL, text) * WIDE_WEIGHT, "ru": float(_count(CYRILLIC, text))}
            letters = len(WORD_MARKS.findall(text))
            if sum(votes.values()) < letters:  # some other script
                votes |= {name: float(len(script.findall(text))) for name, script in SCRIPTS.items()}
    best = max(votes, key=lambda x: votes[x])
    weight = votes[best]
    if not weight:
        return "", 0
    if best == "latin":
        counts: dict[str, int] = {}
        for word in text.lower().split():
            for name in SPEAKERS.get(word.strip(".,;:!?()\""), ()):
                counts[name] = counts.get(name, 0) + 1
        best = max(counts, key=lambda x: counts[x]) if counts else "latin"
    return best, weight


_language = lru_cache(maxsize=4096)(language)


def is_foreign(question: str, answer: str) -> bool:
    """Whether the answer is in another language than the question, which does not name that language."""
    mine, weight = language(answer)
    if not mine or weight < 8:
        return False
    asked, _ = _language(question)
    if asked == "latin" and question.isascii() and len(question.split()) > 3:
        asked = "en"  # in the other languages a sentence without a single stopword hardly occurs
    if not asked or asked == mine or "latin" in (asked, mine) and {asked, mine} <= {"latin", *STOPWORDS}:
        return False
    if mine == "latin" and len(answer.split()) < 3:
        return False
    text = _plain(question)
    return not any(name in text for name in NAMED.get(mine, ()))


def _copied(question: str, answer: str, asked: str, text: str) -> bool:
    """Whether copied runs cover the question and, apart from label words, the answer; ``asked`` and ``text`` are their letters and digits."""
    if len(asked) < 4 or len(text) < COPIED_QUESTION * len(asked):
        return False
    margin = int(len(asked) * (1 - COPIED_QUESTION)) + 1
    core = asked[margin : len(asked) - margin]
    if core not in text:  # any run that covers enough of the question holds its middle
        return False
    covered, longest = SuffixAutomaton(asked).copied(text, max(4, len(core)))
    if longest < COPIED_QUESTION * len(asked):
        return False
    if covered >= COPIED_ANSWER * len(text):
        return True
    rest = _plain(answer)
    for part in (_plain(question).strip(), _plain(question).strip().strip(".。?？!！")):
        rest = rest.replace(part, " ")
    return all(x in LABELS for x in WORD.findall(rest))


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer is nothing but the question, apart from case, spacing, punctuation, labels and repetition.

    Labels may stand before the question and between its parts: where the answer has any, the question is sought once
    more with labels cut out of the answer, and of both.
    """
    asked, text = NOT_ALNUM.sub("", _plain(question)), NOT_ALNUM.sub("", _plain(answer))
    if _copied(question, answer, asked, text):
        return True
    size = min(6, len(asked))
    if size < 4 or len(text) > 3 * len(asked) + 400 or not any(asked[at : at + size] in text for at in range(0, len(asked) - size + 1, max(1, (len(asked) - size) // 4))):
        return False  # labels are short, so a copy holds one of a few pieces of the question whole
    if not LABEL.search(answer):
        return False
    bare, cut = LABEL.sub(" ", question), LABEL.sub(" ", answer)
    text = NOT_ALNUM.sub("", _plain(cut))
    return _copied(question, cut, asked, text) or bare != question and _copied(bare, cut, NOT_ALNUM.sub("", _plain(bare)), text)


def _text_of(value: Any) -> str:
    """The answer within a decoded output: the first text that is no counter."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        kept = {key: item for key, item in value.items() if key not in COUNTERS}
        texts = [item for item in kept.values() if item not in (None, "", [], {})]
        first = next((kept[key] for key in ("output", "answer", "result", "text", "content") if kept.get(key)), texts[0] if texts else "")
        return first if isinstance(first, str) else json.dumps(first, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False) if value != [] else ""


#: The first text in a JSON object that is cut off: a field that is no counter, and its string as far as it goes.
CUT_TEXT = re.compile(r'"(?!(?:inputTokens|outputTokens|totalTokens|tokens|chunks)")[^"\\]+"\s*:\s*"((?:[^"\\]|\\.)*)')


def answer_of(stored: str | None) -> tuple[str, bool]:
    """The answer in ``output_data``, and whether the stored JSON is whole."""
    if stored is None or not stored.strip():
        return "", True
    text = stored.strip()
    if text[0] not in '{["' and text not in ("null", "true", "false"):
        return stored, True
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        found = CUT_TEXT.search(text[1:].replace('\\"', '"') if text[0] == '"' else text)
        return found[1] if found else "", False
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            pass
    return _text_of(value), True


def question_of(stored: str | None) -> str:
    """The question in ``input_data``: a known field of an object, its first text, or the bare text."""
    if stored is None:
        return ""
    try:
        value = json.loads(stored)
    except (ValueError, RecursionError):
        return stored
    if isinstance(value, dict):
        first = next((value[key] for key in QUESTION_FIELDS if isinstance(value.get(key), str)), None)
        return first if first is not None else next((x for x in value.values() if isinstance(x, str)), "")
    return value if isinstance(value, str) else stored


def classify(input_data: str | None, output_data: str | None, error: str | None) -> str | None:
    """The defect of one pair, or None."""
    answer, whole = answer_of(output_data)
    if is_empty(answer):
        failed = _plain(error) if error else ""
        return "refusal" if any(x in failed for x in REFUSED_ERRORS) else "empty"
    if is_refusal(answer):
        return "refusal"
    if not whole:
        return "truncated"
    if error:
        failed = _plain(error)
        if any(x in failed for x in CUT_ERRORS):
            return "truncated"
    question = question_of(input_data)
    if is_copy(question, answer):
        return "copy"
    if is_cut(answer):
        return "truncated"
    return "language" if not is_json(answer) and is_foreign(question, answer) else None


def broken_pairs(frame: DataFrame, key: str = "id", question: str = "input_data", answer: str = "output_data", error: str = "error_message") -> DataFrame:
    """``id, defect`` of every defective pair, one row per id.

    Every row is judged on its own in one pass over the four columns; only defective rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranks = [], []
            for name, *pair in zip(*(batch[x].to_pylist() for x in ("id", "q", "a", "e")), strict=True):
                found = classify(*pair)
                if found:
                    ids.append(name)
                    ranks.append(DEFECTS.index(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int32())], ["id", "rank"])

    rows = frame.select(F.col(key).cast("long").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(error).alias("e")).where(F.col("id").isNotNull())
    found = spread(rows, "id").mapInArrow(run, "id long, rank int").groupBy("id").agg(F.min("rank").alias("rank"))
    return found.select("id", F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("rank") + 1).alias("defect"))
