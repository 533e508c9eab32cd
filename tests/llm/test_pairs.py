import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.pairs import SuffixAutomaton, broken_pairs, classify
from tests.conftest import rows

Q_EN, Q_ZH = "How does the queue work for a new listener?", "请给新听众解释一下重试队列的用法。"
LONG_EN = "The queue keeps what failed. It is tried again when the service is back, and then removed."
LONG_ZH = "重试队列会保存失败的任务。服务恢复以后，它会再试一次，然后删除。"


def pair(question, answer, error=None, field="input"):
    return classify(json.dumps({field: question}), answer if answer is None else json.dumps({"output": answer}), error)


@pytest.mark.parametrize("answer", [None, "", "  ", "​", "\xa0", "...", "-", "N/A", "null", "None", "无", "\n\n"])
def test_empty(answer):
    assert pair(Q_EN, answer) == "empty"
    assert pair(Q_EN, answer, "provider declined the request: blocked by content policy") == "refusal"
    assert pair(Q_EN, answer, "connection refused, attempt 3") == "empty"


@pytest.mark.parametrize("stored", [None, "", "   ", "null", "{}", '{"inputTokens": 3, "tokens": 4}', '{"output": null}', "[]", '{"out', '{"output":"', '{"tokens": 4, "output": ', '{"output": nul'])
def test_stored_without_an_answer(stored):
    assert classify('{"input":"hi there"}', stored, None) == "empty"


@pytest.mark.parametrize("stored", ['{"output":"The queue keeps', '{"tokens": 3, "answer": "The queue \\"keeps', '"{\\"output\\": \\"The queue keeps', '{"output":"The queue keeps it.", "tok'])
def test_stored_answers_that_are_cut_off(stored):
    assert classify('{"input":"hi there"}', stored, None) == "truncated"


@pytest.mark.parametrize("answer", ["I'm sorry, but I can’t help with that request.", "抱歉，我无法讨论重试队列。", "Request declined.", "That is something I must leave to a qualified person; I will not answer it.", "As an assistant it is not possible for me to write material of this sort. Please try another subject.", "这个话题我们还是换一个吧，我不能回答。"])
def test_refusals(answer):
    assert pair(Q_EN, answer) == pair(Q_ZH, answer) == "refusal"


@pytest.mark.parametrize("answer", [
    "I'm sorry, but I can't do that.", "I apologize, but this request goes against our guidelines.", "I don't have the ability to write such a text.", "I am not able to carry out this request.", "Je suis désolé, mais je ne peux pas répondre à cette demande.", "Es tut mir leid, das kann ich leider nicht tun.",
    "Lo siento, no puedo hacer eso.", "Desculpe, não posso ajudar com isso.", "Mi dispiace, non posso rispondere a questa domanda.", "申し訳ありませんが、そのご要望には対応できません。", "죄송하지만 그 요청은 도와드릴 수 없습니다.", "抱歉，这个要求恕难照办。", "К сожалению, я не могу помочь с этим.",
])
def test_refusals_in_other_words_and_languages(answer):
    assert pair(Q_EN, answer) == pair(Q_ZH, answer) == "refusal"


def test_an_inability_of_others_is_no_refusal():
    assert pair("Can the service write to the archive?", "The service cannot write to the archive. It can only read there.") is None
    assert pair(Q_EN, "Listeners can't share a queue. The owner field cannot support two names.") is None


@pytest.mark.parametrize("answer", ['The screen is 5" wide and works well.', "Press [ twice.", "Sure :( that is sad.", "The size is 3 (three.", LONG_EN + " :("])
def test_open_marks_in_texts_that_end(answer):
    assert pair(Q_EN, answer) == (None if answer[-1] == "." else "truncated")


@pytest.mark.parametrize("wrap", ["Answer: {}", "Reply: {}", "回复：{}", "**Your question**\n{}", "[echo] {}", "The original request was: {}"])
@pytest.mark.parametrize("question", [Q_EN, Q_ZH, "Draft a closing line please", "Translate into Spanish: the queue keeps what failed"])
def test_labelled_copies(wrap, question):
    assert pair(question, wrap.replace("{}", question)) == "copy"


def test_copies_with_a_label_inside():
    question = "Explain how the queue works. Then tell a new listener why it is slow in the evening."
    assert pair(question, "Part one: Explain how the queue works.\nPart two: Then tell a new listener why it is slow in the evening.") == "copy"
    assert pair(question, "Part one: It keeps what failed.\nPart two: Then tell a new listener why it is slow in the evening.") is None


@pytest.mark.parametrize("answer", ["تحتفظ قائمة الانتظار بما فشل من المهام ثم تعيد المحاولة لاحقا.", "Η ουρά κρατά ό,τι απέτυχε και δοκιμάζει ξανά αργότερα.", "कतार असफल कार्यों को रखती है और बाद में फिर से प्रयास करती है।", "คิวจะเก็บงาน ที่ล้มเหลว ไว้แล้วลองใหม่ อีกครั้งในภายหลัง", "התור שומר את מה שנכשל ומנסה שוב מאוחר יותר."])
def test_answers_in_other_scripts(answer):
    assert pair(Q_EN, answer + ".") == pair(Q_ZH, answer + ".") == "language"
    assert pair(answer, " ".join(reversed(answer.strip(".").split())) + " " + answer[:12] + ".") is None


@pytest.mark.parametrize("answer", ["A polite wording would be: \"I'm sorry, but I can't help with that request.\" " + LONG_EN, "Host A: I cannot recommend it enough!\nHost B: " + LONG_EN, "Host A: I'm sorry we started late today.\n" + LONG_EN])
def test_no_refusals(answer):
    assert pair(Q_EN, answer) is None


def test_no_refusals_in_chinese():
    assert pair(Q_ZH, "可以这样写：“抱歉，我无法提供这方面的帮助。”" + LONG_ZH) is None
    assert pair(Q_ZH, "主播甲：我没法再多夸它一句了！\n主播乙：" + LONG_ZH) is None


@pytest.mark.parametrize("answer", [LONG_EN[:-30], LONG_ZH[:-9], LONG_EN + " It said (and then", "```\nsteps:\n  - name: Ask", LONG_EN + " For example, the", "1. first of all things\n2. second of all things\n3."])
def test_cut(answer):
    assert pair(Q_EN if answer.isascii() else Q_ZH, answer) == "truncated"


def test_cut_by_error_or_storage():
    assert pair(Q_EN, LONG_EN, "finish_reason=length (limit 549)") == "truncated"
    assert classify(None, '{"output":"The queue keeps what fai', None) == "truncated"
    assert pair(Q_EN, LONG_EN, "retry 2 of 3 succeeded") is None and pair(Q_EN, LONG_EN, "read timed out after 5 ms") is None


@pytest.mark.parametrize("answer", ["Yes", "no", "34", "/audio/a5ce6e20.wav", '{"title":"x","minutes":3}', "```\ntopic: x\n```", "Night Trains after Hours", "- one thing we kept\n- another thing we kept", "1. first of all things\n2. second of all things", LONG_EN + "\n\nEnd of script"])
def test_complete_short_answers(answer):
    assert pair(Q_EN, answer) is None and pair("给一期节目起个标题", answer if len(answer) < 12 else "雨后的令牌预算") is None


@pytest.mark.parametrize("wrap", ["{}", "  {}\n", '"{}"', "Question: {}", "{}\n{}", "> {}"])
@pytest.mark.parametrize("question", [Q_EN, Q_ZH, "为脚本草稿写一句结束语", "Draft a closing line please"])
def test_copies(wrap, question):
    assert pair(question, wrap.replace("{}", question)) == "copy"
    assert pair(question, wrap.replace("{}", question).upper().replace("，", ",")) == "copy"


def test_no_copies():
    assert pair(Q_EN, f'You asked: "{Q_EN}" Here is the answer. {LONG_EN}') is None
    assert pair("Explain the queue", "The queue") is None
    assert pair(None, LONG_EN) is None and pair("", LONG_EN) is None


def test_languages():
    spanish = "Conviene revisar la lista de voces antes de abrir la cola de reintentos por completo."
    assert pair(Q_EN, LONG_ZH) == pair(Q_ZH, LONG_EN) == pair(Q_EN, spanish) == pair(Q_ZH, spanish) == "language"
    assert pair(Q_EN, "再試行の列が遅いときは用語表を先に閉じます。") == "language"
    assert pair("Translate into Spanish: " + LONG_EN, spanish) is None and pair("翻译成英文：" + LONG_ZH, LONG_EN) is None
    assert pair(Q_EN, LONG_EN + " Terms kept in the original: 夜间摘要, 云的形状.") is None
    assert pair(Q_ZH, "/audio/33ce8bd5.wav") is None


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=12), st.text("abc", max_size=14), st.integers(1, 4))
def test_suffix_automaton(text, other, least):
    machine = SuffixAutomaton(text)
    sizes = machine.matches(other)
    for end, size in enumerate(sizes):
        assert size == max(n for n in range(end + 2) if other[end + 1 - n : end + 1] in text)
    marked = set()
    for end, size in enumerate(sizes):
        if size >= least:
            marked |= set(range(end - size + 1, end + 1))
    assert machine.copied(other, least)[0] == len(marked)


def test_table(spark):
    shape = "id long, input_data string, output_data string, error_message string, rank int, defect string"
    good, bad = json.dumps({"output": LONG_EN}), json.dumps({"output": "-"})
    data = [(1, json.dumps({"input": Q_EN}), good, None, 0, "x")] * 2 + [(2, None, bad, None, 0, "x")] * 2 + [(3, Q_EN, good, None, 0, "x"), (None, None, None, None, 0, "x"), (4, None, None, None, 0, None), (5, Q_EN, good, None, 0, ""), (5, Q_EN, bad, None, 0, ""), (6, Q_EN, json.dumps({"output": "word " * 200_000 + "end."}), None, 0, "")]
    frame = spark.createDataFrame(data, shape)
    assert rows(broken_pairs(frame)) == [(2, "empty"), (4, "empty"), (5, "empty")]
    assert broken_pairs(frame.limit(0)).count() == 0
