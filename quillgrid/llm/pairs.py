"""Defective prompt and response pairs.

Method
------
Openings of responses (their first sentence, names and numbers masked) are
clustered by verified MinHash.  What recurs across unrelated prompts is a
response template.  A template reveals a refusal if it speaks of the request
and declines it, or if none of its wording belongs to the collection's subject
(the vocabulary of all prompts) and it names nothing; short templates of that
kind are placeholders.  Templates about
the matter ("the tool cannot resolve an exon") recur as well and stay sound.
Placeholders are learned too from choice questions, whose answer picks none of
the options.  Copies, broken-off endings and other languages are judged on
whole pairs, the language by script and, within one script, by the collection's
own vocabulary.

One defect a pair, the first of: empty, refusal, copy, truncated, language.
A pair of a choice type can only be empty if its answer is a choice, that is, if
the pair has options to choose from.  Facts have a type, but no options: their
answers are texts whatever the type, and are judged as texts.

Defined results
---------------
* a null, blank or placeholder answer is empty, whatever the question
* with a null or blank question an answer is neither a copy nor in another language
* bare names, codes, terms and short phrases are sound; so is an answer that
  restates the question and then answers it
* an unknown type counts as a text type; repeated rows are each labelled
* without a column ``options`` every pair of a choice type counts as one that has options
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from . import wording as W
from .cores import core_string, distinct_windows
from .lookalike import canonical
from .neardup import class_links

CHOICES = ("single_choice", "multiple_choice")
#: Cores of placeholders; an answer without letters and digits is empty as well.
PLACEHOLDERS = frozenset(
    "无 暂无 暂无答案 无答案 没有答案 答案暂无 待补充 待补 待定 待完善 待填 待更新 略 答案略 空 空白 未填 未填写 none null nil nan na tbd tba todo tbc "
    "pending empty blank noanswer noansweryet answerpending toappear tobeadded placeholder comingsoon notavailable keineangabe sansréponse sinrespuesta "
    "未知 未提供 未给出 未作答 未答 未录入 暂缺 缺失 缺 不详 待录入 待确认 待查 待审核 待核对 待编辑 待整理 同上 见上 见教材 见解析 见答案 详见教材 详见解析 参考答案略 解析略 此处略 省略 从略 暂不提供 尚未填写 尚无答案 "
    "无内容 答案缺失 答案待补 答案待定 答案待补充 请填写 请输入答案 unknown undefined missing seeabove asabove sameasabove ditto unanswered notgiven notprovided notapplicable noresponse nocontent "
    "fixme xxx xx tobedetermined tobedone tobeannounced tobecompleted tobeconfirmed tobefilled tobefilledin answerhere youranswerhere inserthere insertanswerhere loremipsum noneprovided nodata emptyanswer answermissing omitted skip skipped".split()
)
#: Unrelated prompts that make an opening a template.
RECURS = 3
#: Share of subject words in the vocabulary, at most: for a template to be off the subject, and for a text that declines.
OFF_SUBJECT, OFF_SUBJECT_DECLINES = 0.15, 0.6
#: Letters of a placeholder at most, in scripts with and without spaces.
_SHORT_WORDS, _SHORT_LETTERS = 4, 7

# Who or what is spoken of when a request is declined, and the inability or unwillingness; fixed values by language.
_ABOUT_WORDS = {
    "en": "i i'm i’m i'd i’d i've i’ve me my myself we us our answer answers answered answering assist assistance assistant help comment comments discuss discussion question questions request requests explain respond reply tutor instructor advise",
    "de": "ich mir mich wir frage fragen anfrage antwort antworten beantworten beantwortet auskunft helfen weiterhelfen hierzu dazu",
    "fr": "je j'ai moi nous question questions demande répondre réponse aider aide assistant",
    "es": "yo me nosotros pregunta preguntas solicitud responder respuesta ayudar ayudarte ayudarle contestar asistente",
    "it": "io mi noi domanda domande richiesta rispondere risposta aiutare aiutarti assistente",
    "pt": "eu me nós pergunta perguntas pedido solicitação responder resposta ajudar ajudá-lo assistente",
    "nl": "ik mij me wij vraag vragen verzoek antwoord antwoorden beantwoorden helpen",
    "sv": "jag mig vi fråga frågan frågor svar svara besvara hjälpa",
    "da": "jeg mig vi spørgsmål spørgsmålet spørsmål spørsmålet svar svare besvare hjælpe hjelpe",
    "fi": "minä kysymys kysymykseen kysymyksiin vastata vastaus auttaa",
    "pl": "ja pytanie pytania prośba prośbę odpowiedzieć odpowiedź odpowiedzi odpowiadać pomóc",
    "cs": "já otázka otázku otázky dotaz odpovědět odpověď pomoci pomoct",
    "hu": "kérdés kérdésre válasz válaszolni segíteni",
    "ro": "eu întrebare întrebarea întrebări răspunde răspuns ajuta",
    "tr": "ben soru soruya soruyu sorular cevap yanıt yanıtlamak cevaplamak yardımcı",
    "vi": "tôi hỏi lời giúp",
    "id": "saya pertanyaan menjawab jawaban membantu permintaan",
    "ru": "я мне мы вопрос вопросы запрос ответить ответ отвечать помочь",
    "uk": "мені ми питання запитання відповісти відповідь допомогти",
    "el": "ερώτηση ερώτημα απαντήσω απάντηση βοηθήσω",
    "ar": "أنا السؤال سؤال سؤالك الإجابة أجيب إجابة مساعدتك المساعدة الطلب",
    "he": "אני השאלה שאלה לענות לעזור תשובה",
    "hi": "मैं प्रश्न सवाल उत्तर जवाब मदद सहायता",
}
_ABOUT_PARTS = (
    "我 本人 本助手 本系统 本模型 助手 机器人 语言模型 人工智能 回答 作答 答复 解答 答案 答不 任何解释 作出判断 做出判断 这道题 这题 该题 此题 本题 此类请求 这类请求 该请求 此请求 这个问题 此问题 该问题 本问题 这类问题 此类问题 您的问题 你的问题 "
    "这个话题 该话题 此话题 提问 换个问题 别的问题 其他问题 请咨询 请教老师 请问老师 问老师 恕 帮不 帮忙 协助 帮助您 帮助你 帮到您 帮到你 奉告 置评 另请高明 爱莫能助 "
    "お答え 回答 ご質問 質問 私は 私に お手伝い 답변 대답 질문 저는 도와 도움 คำถาม ตอบ ช่วยเหลือ ฉัน"
).split()
_UNABLE_WORDS = {
    "en": "can't can’t cannot unable declin\\w* won't won’t wouldn't shouldn't sorry unfortunately beyond refus\\w* apolog\\w* regret skip skipping pass unsure decline forbidden prohibited inappropriate uncomfortable unauthorized unauthorised",
    "de": "leider entschuld\\w* verweiger\\w* unmöglich bedauer\\w* ablehn\\w*",
    "fr": "désolé\\w* malheureusement regrette impossible refuse navré\\w* incapable excus\\w*",
    "es": "lamento lamentablemente desgraciadamente imposible disculp\\w* perdón rechaz\\w* siento",
    "it": "dispiace purtroppo impossibile scus\\w* rifiut\\w* spiacente",
    "pt": "desculp\\w* infelizmente lamento impossível recus\\w*",
    "nl": "helaas sorry weiger\\w* onmogelijk spijt excuses",
    "sv": "tyvärr beklagar ledsen vägrar",
    "da": "desværre beklager dessverre nægter undskyld",
    "fi": "valitettavasti pahoittelen anteeksi",
    "pl": "niestety przepraszam odmawiam przykro",
    "cs": "bohužel nemohu omlouvám nelze nemůžu",
    "hu": "sajnos sajnálom elnézést",
    "ro": "păcate rău scuze",
    "tr": "üzgünüm maalesef edemem edemiyorum veremem veremiyorum olamam olamıyorum cevaplayamam cevaplayamıyorum yanıtlayamam yanıtlayamıyorum",
    "vi": "xin lỗi tiếc",
    "id": "maaf tidak",
    "ru": "извин\\w* сожалению простите отказ\\w* невозможно",
    "uk": "вибач\\w* жаль перепрош\\w* неможливо",
    "el": "λυπάμαι συγγνώμη δυστυχώς",
    "ar": "آسف عذرا عذرًا أعتذر للأسف أستطيع يمكنني",
    "he": "מצטער מצטערת יכול יכולה",
    "hi": "क्षमा माफ़ माफ खेद असमर्थ",
}
_UNABLE_PARTS = (
    "无法 不能 不便 不会 没办法 没法 没有办法 没有足够 不够了解 超出 超过 超纲 不予 难以 难提供 帮不 抱歉 对不起 不好意思 遗憾 拒绝 拒答 谢绝 婉拒 不可以 恕 不知道 不清楚 不了解 不懂 不晓得 不确定 不想 不愿 不方便 不适合 不合适 不宜 不允许 "
    "不被允许 禁止 违反 跳过 略过 放弃 爱莫能助 无可奉告 无从 未能 做不到 做不了 答不 没学过 没有权限 不具备 不在我 暂不 另请高明 换个 "
    "申し訳 できません できかね 出来ません 分かりません わかりません かねます 控え お断り 죄송 없습니다 어렵습니다 못합니다 모르겠 곤란 ขอโทษ ขออภัย ไม่สามารถ không_thể"
).replace("_", " ").split()
_UNABLE_PHRASES = [
    r"can ?not\b", r"\bnot able\b", r"\bwill not\b", r"\bwould not\b", r"\b(?:don't|don’t|do not|does not|didn't) (?:have|know|want|think|feel|wish|understand|answer|discuss|comment)\b", r"\bnot answered\b", r"\bno (?:comment|idea|clue|way)\b",
    r"\b(?:i'm|i’m|i am|we are) not\b", r"\brather not\b", r"\bprefer not\b", r"\bnot (?:comfortable|permitted|allowed|sure|certain|qualified|going to|in a position|something)\b", r"\boutside\b", r"\bask (?:your|a|someone|another)\b", r"\b(?:another|different) question\b",
    r"\bkann .*nicht\b", r"\bnicht (?:beantworten|möglich|helfen|sagen)\b", r"\bkeine (?:antwort|auskunft|angaben?)\b", r"\bne (?:peux|puis|suis|sais|peut|pouvons) pas\b", r"\bje ne\b", r"\bno (?:puedo|es posible|podemos|sé|estoy)\b", r"\bnon (?:posso|sono|so|è possibile)\b", r"\bnão (?:posso|sou|sei|consigo|é possível)\b",
    r"\bkan .*niet\b", r"\bniet (?:beantwoorden|helpen)\b", r"\bkan (?:tyvärr )?(?:inte|ikke)\b", r"\ben (?:voi|pysty|osaa)\b", r"\bnie (?:mogę|jestem|potrafię|wiem|można)\b", r"\bnem (?:tud\w*|áll)\b", r"\bnu pot\b", r"\btidak (?:dapat|bisa)\b", r"\bkhông thể\b",
    r"\bне (?:могу|можу|знаю|в состоянии)\b", r"\bδεν μπορώ\b", r"\bلا (?:أستطيع|يمكنني)", r"\bלא (?:יכול|יכולה)\b", r"नहीं (?:दे )?सकत",
]


def _any_of(words: dict[str, str], parts: list[str], phrases: list[str] = ()) -> re.Pattern:
    whole = sorted({w for ws in words.values() for w in ws.split()})
    return re.compile("|".join([rf"(?<!\w)(?:{'|'.join(whole)})(?!\w)", *map(re.escape, parts), *phrases]), re.I)


_ABOUT = _any_of(_ABOUT_WORDS, _ABOUT_PARTS)
_UNABLE = _any_of(_UNABLE_WORDS, _UNABLE_PARTS, _UNABLE_PHRASES)
_L, _N = "A-Za-zÀ-ɏΑ-ω", "A-Za-zÀ-ɏΑ-ω0-9"
_NAMES = re.compile(f"[{_L}]*[0-9][{_N}.%-]*|[{_L}]*[a-z][A-Z][{_N}]*(?:-[{_N}]+)*|[A-Z][{_L}]*-[A-Z0-9]+|(?<![{_N}])[A-Z]{{2,}}[{_N}]*")
#: A capital inside a sentence, or Latin letters next to an ideograph.
_INNER_NAME = re.compile(r"(?<=[a-z,;] )[A-Z](?!['’ ])|[一-鿿] ?[A-Za-zÀ-ɏ]|[A-Za-zÀ-ɏ] ?[一-鿿]")
_SENTENCE = re.compile(r".+?(?:[。．!！?？｡।॥؟۔։።]|\.(?=\s|$)|\n|$)", re.S)
_ENDED = re.compile(r"[。．.!！?？｡।॥؟۔։።][\s”’\"'»」』）)\]】》]*$")
_REFERENCE = re.compile(r"[（(\[【][^（()）\[\]【】]{1,40}[）)\]】]\s*$")
_LIST_MARK = re.compile(r"(?<!\d)[;；,，:：、。.!?]\s*[（(]?(?:\d{1,2}|[一二三四五六七八九十])[)）.、，,]\s*$|(?:首先|其次|再次|最后|第[一二三四五六七八九十])[，,、:：]?\s*$")
_OPEN_END = re.compile(r"[,，;；:：、—（(\[【《“‘「『-]\s*$")
_DANGLING = re.compile(
    r"(?:[的与和及或而但]|以及|如果|即|例如|比如|因为|由于|尤其当|其中|从而|使得|直到|并且|参见)$"
    r"|\b(?:the|a|an|of|to|in|and|or|but|with|for|by|from|that|which|because|although|between|such as|if|when|while|as|at|on|is|are)$",
    re.I,
)
_CLAUSES = re.compile(r"[，。；,;](?=\s|[^\d\s])")
_PAIRED = dict(zip("（([【《“‘「『", "）)]】》”’」』", strict=True))
#: What may stand before a copied question, and after it.
_LABEL_LETTERS = 40
_LABEL_END = re.compile(r"[:：\n\t“\"'‘「『《(（\[【>＞—=-]\s*$")
_AFTER_COPY = re.compile(r"[\s?？。.!！”’\"'」』》)）\]】…—-]*(?:[（(\[【][^（()）\[\]【】]{0,30}[）)\]】])?[\s?？。.!！…]*")
_AFTER_WORDS = frozenset("同上 如题 同题 略 见上 如上 即此 ditto same asabove seeabove question asked end".split())
#: Words of running text; fixed values by language.
_WORDS = {
    "en": "the of and to in is that with for by from has be as not are which at so only its this cannot".split(),
    "de": "der die das und nicht mit dem den von wird werden ist nach noch weil ein eine danach zu auf kurzen einmal muss".split(),
    "fr": "le la les de des et est un une que dans pour pas avec puis ne il faut du parce reste".split(),
    "es": "el la los las de y que en un una con hay no por es del después se para quitar primero".split(),
    "it": "il lo gli di che è un una con per non del della sono nel dopo prima bisogna".split(),
    "pt": "o os as de que e um uma com não por do da é em depois para primeiro".split(),
}
_WORD_SETS = {k: frozenset(v) for k, v in _WORDS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")
#: Plain words of running text in a language that has no list above.
_RUNNING = 6
#: Share of a text's words that are the collection's own: below, foreign; above, its own language.
_FOREIGN, _OWN = 0.34, 0.5
#: Share of words that any English text has of the most common ones, at least.
_FUNCTION = 0.15
_LATIN = ("latin", *_WORDS)


def opening(answer: str) -> str:
    """The first sentence of an answer, with names, codes and numbers masked."""
    first = _SENTENCE.match(answer.strip())
    return _NAMES.sub("#", first[0].strip() if first else "").lower()


def declines(answer: str) -> bool:
    """Whether the first two sentences speak of the request and decline it."""
    start = _NAMES.sub("#", "".join(_SENTENCE.findall(answer.strip())[:2]))
    return bool(_UNABLE.search(start) and _ABOUT.search(start))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    core = core_string(answer)
    return not core or core in PLACEHOLDERS


def _short(text: str) -> bool:
    """Few enough words for a placeholder."""
    words = _LETTERS.findall(text)
    return len(words) <= _SHORT_WORDS and all(len(w) <= _SHORT_LETTERS or w.isascii() for w in words)


def is_copy(question: str | None, answer: str) -> bool:
    """Whether an answer only repeats the question; both in their one form (``lookalike``)."""
    q = core_string(question)
    if not q:
        return False
    a = core_string(answer)
    at = a.find(q)
    if at < 0:  # the question with a few characters changed or left out
        if not (8 <= len(a) <= len(q) * 1.05 and len(a) >= 0.7 * len(q)):
            return False
        own, asked = {a[i : i + 3] for i in range(len(a) - 2)}, {q[i : i + 3] for i in range(len(q) - 2)}
        return len(own & asked) >= 0.9 * len(own)
    before, after = a[:at], a[at:].replace(q, "")
    if after and after not in _AFTER_WORDS:
        # Marks and a remark in brackets may follow; what else follows answers.
        raw = answer.strip()
        tail = len(raw)
        while tail and len(core_string(raw[tail - 1 :])) < len(after):
            tail -= 1
        if not _AFTER_COPY.fullmatch(raw[max(0, tail - 2) :]) or len(after) > 30:
            return False
    if not before:
        return True
    if len(before) > _LABEL_LETTERS:
        return False
    if len(before) <= 6:
        return True
    raw, head = answer.strip(), 0
    while head < len(raw) and len(core_string(raw[:head])) < len(before):
        head += 1
    while head < len(raw) and not core_string(raw[head]):
        head += 1
    return bool(_LABEL_END.search(raw[:head]))


def is_truncated(answer: str) -> bool:
    s = answer.strip()
    if _LIST_MARK.search(s) or _OPEN_END.search(s):
        return len(s) > 2
    while (m := _REFERENCE.search(s)) and m.start() > 0 and _ENDED.search(s[: m.start()].rstrip()):
        s = s[: m.start()].rstrip()
    depth: dict[str, int] = {}
    for c in s:
        if c in _PAIRED:
            depth[_PAIRED[c]] = depth.get(_PAIRED[c], 0) + 1
        elif depth.get(c, 0):
            depth[c] -= 1
    if any(depth.values()):
        return True
    if _ENDED.search(s) and not s.endswith(("...", "…")):
        return False
    if _DANGLING.search(s):
        return True
    wide = sum(1 for c in s if "一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힣")
    if wide > len(s) * 0.15:
        return bool(_CLAUSES.search(s)) or wide > 30
    words = s.split()
    return len(words) >= 8 or (len(words) >= 4 and bool(_CLAUSES.search(s)))


def language_of(text: str, counts: np.ndarray, plain: int) -> tuple[str, bool]:
    """The language of a text, or its script, and whether it is running text.

    ``counts``: its letters by script; ``plain``: its words that are no names.
    """
    by = dict(zip(W.SCRIPTS, counts.tolist(), strict=True))
    if by["kana"] >= 5 and by["kana"] * 4 >= by["han"]:
        return "ja", by["kana"] + by["han"] >= 10
    if by["hangul"] >= 5 and by["hangul"] >= by["han"]:
        return "ko", by["hangul"] >= 8
    for script in ("cyrillic", "greek", "arabic", "hebrew", "thai", "devanagari", "other"):
        if by[script] >= 8 and by[script] * 2 >= by["latin"] and by[script] >= by["han"]:
            return script, by[script] >= 12
    if by["han"] and by["han"] * 8 >= by["latin"]:
        return "zh", by["han"] >= 8
    if not by["latin"]:
        return "none", False
    words = [w.lower() for w in _LETTERS.findall(text)]
    hits = {k: sum(w in s for w in words) for k, s in _WORD_SETS.items()}
    best = max(hits, key=hits.get)
    if hits[best] >= 2:
        return best, len(words) >= 5
    return ("latin" if not hits[best] else best), plain >= _RUNNING and (bool(_ENDED.search(text)) or plain > _RUNNING + 2)


def _first_like(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One minwise value of each prompt: unrelated prompts have different ones."""
    out = np.zeros(n, np.uint64)
    if len(tokens):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[starts]] = np.minimum.reduceat(tokens, starts)
    return out.view(np.int64)


def _shared(q: tuple[np.ndarray, np.ndarray], answers: list[str]) -> np.ndarray:
    """Of each pair, the share of the question's windows of three letters that the answer has."""
    n = len(answers)
    a = distinct_windows(answers, 3)
    key = np.concatenate([(x[1].astype(np.uint64) << np.uint64(44)) | x[0] for x in (q, a)])
    key.sort()
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64), minlength=n)
    return both / np.maximum(1, np.bincount(q[1], minlength=n))


def _looked_at(pairs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """What each pair shows by itself.

    (rec, rec_id, choice, label, short, opening, about, bare, prompt): ``short``
    is the core of an answer that may be a placeholder, ``opening`` that of one
    whose wording is off the subject or declines (``about``), and ``bare`` says
    that it names nothing.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = batch["answer"].tolist()
            questions = canonical().of_all(["" if q is None else q for q in batch["question"].tolist()])
            answers = canonical().of_all(["" if a is None else a for a in raw])
            n = len(answers)
            windows = distinct_windows(questions, 3)
            prompt = _first_like(*windows, n)
            shared = _shared(windows, answers)
            subject, inside, plain = W.subject_counts(answers, vocabulary.value)
            asked, own, _ = W.subject_counts(questions, vocabulary.value)
            scripts_a, scripts_q = W.script_counts(answers), W.script_counts(questions)

            def differ(a: str, q: str, k: int) -> bool:
                """Whether two languages are different ones; within one alphabet without word lists for both, by the collection's words."""
                if a in _LATIN and q in _LATIN:
                    if a != q and "latin" not in (a, q):
                        return True
                    foreign = inside[k] < _FOREIGN * subject[k] and plain[k] - subject[k] < _FUNCTION * plain[k]
                    return bool(foreign and plain[k] >= _RUNNING and own[k] >= _OWN * max(1, asked[k]))
                return a != q and q != "none"

            rows = []
            for k, (rec, number, choice, picks) in enumerate(zip(*(batch[c].tolist() for c in ("rec", "rec_id", "choice", "picks")), strict=True)):
                question, answer = questions[k], answers[k]
                label, short, start, about, bare = None, None, None, False, False
                share = inside[k] / subject[k] if subject[k] else 1.0
                if is_empty(raw[k]) or picks is False:
                    label = "empty"
                    short = core_string(answer) or None if picks is False else None
                else:
                    if not inside[k] and _short(answer) and not any(c.isdigit() for c in answer):
                        short = core_string(answer)
                    rest = answer.replace(question.strip(), " ") if question.strip() and shared[k] > 0.8 else answer
                    about = not choice and (share <= OFF_SUBJECT_DECLINES or rest is not answer) and declines(rest)
                    if about or share <= OFF_SUBJECT:
                        start = opening(rest)
                        bare = "#" not in start and not _INNER_NAME.search(answer)
                    if not choice:
                        if shared[k] > 0.4 and is_copy(question, answer):
                            label = "copy"
                        elif is_truncated(answer):
                            label = "truncated"
                        elif question.strip():
                            a, running = language_of(answer, scripts_a[k], plain[k])
                            if running:
                                q, _ = language_of(question, scripts_q[k], asked[k])
                                label = "language" if differ(a, q, k) else None
                if label or short or start:
                    rows.append((rec, number, bool(choice), label, short, start, about, bare, prompt[k]))
            yield pd.DataFrame(rows, columns=["rec", "rec_id", "choice", "label", "short", "opening", "about", "bare", "prompt"])

    schema = "rec string, rec_id long, choice boolean, label string, short string, opening string, about boolean, bare boolean, prompt long"
    return pairs.mapInPandas(look, schema)


def placeholders(seen: DataFrame) -> DataFrame:
    """Cores of short answers that are placeholders: those that choice questions show, and those of no subject that recur across unrelated prompts."""
    short = seen.filter(F.col("short").isNotNull())
    shown = short.filter("label = 'empty'").select("short")
    recurring = short.filter("label IS NULL AND bare AND NOT about").select("short", "prompt").distinct().groupBy("short").count().filter(F.col("count") >= RECURS).select("short")
    return shown.unionByName(recurring).distinct()


def refusal_openings(seen: DataFrame) -> DataFrame:
    """Openings of the clusters that decline, or that recur across unrelated prompts and are off the subject."""
    known = seen.filter(F.col("opening").isNotNull())
    counted = known.select("opening", "prompt").distinct().groupBy("opening").agg(F.count("*").alias("prompts"))
    kinds = known.groupBy("opening").agg(F.max("about").alias("about"), F.min("bare").alias("bare"))
    openings = checkpoint(kinds.join(counted, "opening"))
    links, rows = class_links(openings.select(F.col("opening").alias("name"), F.col("opening").alias("text")), "name", n=2, threshold=0.5)
    members = rows.select(F.col("name").alias("opening"), "core")
    sums = [F.sum("prompts").alias("prompts"), F.max("about").alias("about"), F.min("bare").alias("bare")]
    classes = checkpoint(openings.join(members, "opening").groupBy("core").agg(*sums))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.select(F.col("core").alias("a"), F.col("core").alias("b")))
    clusters = both.join(classes.withColumnRenamed("core", "b"), "b").groupBy("a").agg(*sums).withColumnRenamed("a", "core")
    template = clusters.filter((F.col("prompts") >= RECURS) & (F.col("about") | F.col("bare"))).select("core")
    return members.join(template, "core", "left_semi").select("opening").unionByName(openings.filter("about").select("opening")).distinct()


def _named_keys() -> Column:
    """Whether an answer is one or more letters of options."""
    keys = F.coalesce(F.trim("answer").rlike(r"^[A-Za-zＡ-Ｚ]([\s,，、;；/+和]*[A-Za-zＡ-Ｚ]){0,11}$"), F.lit(False))
    return keys & ~F.coalesce(F.lower(F.trim("answer")).isin("n/a", *[p for p in PLACEHOLDERS if p.isascii()]), F.lit(False))


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(rec, rec_id, defect) of pairs (rec, rec_id, question, answer, type[, options])."""
    choice = F.coalesce(F.col("type").isin(*CHOICES), F.lit(False))
    if "options" in pairs.columns:
        choice = choice & F.coalesce(F.size("options") > 0, F.lit(False))
        # The answer of a choice question names a key or repeats the text of an option.
        text = F.exists(F.col("options"), lambda o: (F.length(F.trim(o["text"])) > 0) & F.contains(F.coalesce(F.col("answer"), F.lit("")), F.trim(o["text"])))
        picks = F.when(choice, _named_keys() | F.coalesce(text, F.lit(False)))
    else:
        picks = F.lit(None).cast("boolean")
    kept = pairs.filter(~(choice & _named_keys())).select("rec", "rec_id", "question", "answer", choice.alias("choice"), picks.alias("picks"))
    seen = checkpoint(_looked_at(kept, W.vocabulary(pairs, F.col("question"))))
    openings = refusal_openings(seen).withColumn("template", F.lit(True))
    named = seen.join(openings, "opening", "left").join(placeholders(seen).withColumn("blank", F.lit(True)), "short", "left")
    refused = ~F.col("choice") & F.coalesce("template", F.lit(False))
    blank = F.coalesce("blank", F.lit(False)) & ~F.col("about")
    defect = F.when((F.col("label") == "empty") | blank, "empty").when(refused, "refusal").otherwise(F.col("label"))
    return named.select("rec", "rec_id", defect.alias("defect")).filter(F.col("defect").isNotNull())


__all__ = ["declines", "defective_pairs", "is_copy", "is_empty", "is_truncated", "language_of", "opening"]
