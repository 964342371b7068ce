"""Wordings by which a reply declines to answer or says that no answer can be given."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

# Patterns of wordings, by language, in lower case.
WORDINGS = {
    "en": r"""
        \bi(?:'m| am)? ?(?:can(?:no|'|’)?t|can not|won(?:'|’)t|will not|am unable|unable|not able|(?:'|’)d rather not|would rather not|have to decline|must decline|must refuse|do(?:n'?’?t| not) know|refuse to)
        \bno answer (?:can|could) be (?:given|found|provided) | \bcan(?:no|'|’)?t be (?:determined|answered|established|said|inferred|found)
        \bcannot (?:answer|help|determine|provide|assist) | \bunable to (?:help|answer|assist|determine|provide) | \bhave to decline | \brather not (?:respond|answer|say) | \bwon(?:'|’)t speculate
        \bnot answerable | \bunanswerable | \bnone of the (?:retrieved |given |provided )?(?:texts?|passages?|documents?|sources?|excerpts?)\b | \binsufficient (?:information|context|data|evidence) | \bnot enough (?:information|context|data|evidence) | \black(?:s|ing)? (?:the )?(?:needed|necessary|required) (?:facts|information|details)
        \b(?:passages?|context|texts?|excerpts?|documents?|sources?)\b.{0,30}\b(?:do(?:es)?(?: not|n'?’?t)|never|nothing|silent|lacks?)\b | \bmissing from the (?:excerpts?|passages?|context|texts?|documents?)
        \bbeyond what (?:these|the) | \b(?:question|matter) (?:stays|remains) open | \bconsult (?:another|a different) source | \bnothing (?:suitable|matches|relevant) | \bguidelines\b.{0,20}\b(?:keep|prevent|forbid|don) | \bas an? (?:ai|language model|assistant)
        \bno generation | \brequest (?:was )?(?:declined|rejected|refused|blocked) | \b(?:declined|rejected|blocked) by (?:the )?(?:model )?service | \bservice (?:unavailable|error|timeout) | \bcontent (?:filter|policy) | \brate limit | \brequest timed out | \bgeneration rejected""",
    "fr": r"""
        \bje (?:ne |n['’])?(?:peux|puis|sais|suis) (?:pas|malheureusement)|\bje ne (?:peux|saurais|souhaite|veux)|\bpréfère ne pas|\bm['’]abstiens|\bm['’]est impossible|\bimpossible de (?:répondre|traiter|le dire)
        \baucune réponse|\baucun des (?:passages|textes|extraits)|\binformations? insuffisante?s?|\bne (?:contient|contiennent|permet|permettent|mentionne|mentionnent|précise|donne|donnent) (?:pas|rien|aucune?)|\bn['’]en parle(?:nt)? pas|\bpas assez d['’](?:éléments|informations?)|\bne peut être (?:tirée|donnée|déterminée)|\bne (?:dit|disent) rien""",
    "de": r"""
        \bweiß (?:es |ich |leider )*nicht|\bich (?:kann|möchte|muss|will|darf|werde)\b.{0,60}\b(?:nicht|nichts|keine|schuldig|ablehnen|enthalten)|\b(?:kann|muss|möchte) ich\b.{0,60}\b(?:nicht|nichts|keine|schuldig|ablehnen|passen)|\blässt sich\b.{0,40}\bnicht (?:ableiten|beantworten|sagen|bestimmen|ermitteln|entnehmen)
        \b(?:kontext|text|textstellen|auszüge|auszügen|abschnitte|passagen)\b.{0,40}\b(?:nicht|nichts|keine)\b|\bsteht\b.{0,40}\bnichts\b|\bunzureichende (?:angaben|informationen)|\bnicht genügend (?:angaben|informationen)|\bkeine (?:antwort|angaben|auskunft)|\bkeine[rs]? der (?:texte|textstellen|auszüge|passagen)|\bnicht (?:beantworten|äußern)""",
    "es": r"""
        \bno (?:puedo|podría|me es posible|es posible|estoy en condiciones|sé)\b|\bprefiero no|\bdebo abstenerme|\bme abstengo|\bno pronunciarme
        \binformación insuficiente|\bdatos insuficientes|\bno (?:contiene|contienen|menciona|mencionan|dice|dicen|hay|ofrece)\b.{0,30}(?:información|nada|datos|suficiente)|\bno se puede (?:obtener|responder|determinar|saber)|\bsin respuesta|\bningun[oa] de l[oa]s (?:textos|pasajes|fragmentos)""",
    "it": r"""
        \bnon (?:posso|sono in grado|saprei|mi è possibile|è possibile)\b|\bpreferisco non|\bmi astengo|\bdevo astenermi|\bnon pronunciarmi
        \binformazioni insufficienti|\bdati insufficienti|\bnon (?:contiene|contengono|ne parlano|ne parla|menziona|menzionano|dice|dicono)|\bnon si può (?:ricavare|rispondere|dedurre|dire)|\bnessuna risposta|\bnessuno dei (?:testi|passi|brani)|\bnon (?:è|se ne) (?:ricava|deducibile)""",
    "pt": r"""
        \bnão (?:posso|consigo|me é possível|é possível|sei|estou em condições)\b|\bprefiro não|\bdevo abster|\babstenho|\bnão me pronunciar
        \binformação insuficiente|\binformações insuficientes|\bdados insuficientes|\bnão (?:contém|contêm|falam?|menciona|mencionam|diz|dizem|há)\b|\bnão se pode (?:obter|tirar|responder|determinar|saber)|\bnenhuma resposta|\bnenhum dos (?:textos|trechos)""",
    "nl": r"""
        \b(?:ik kan|kan ik|ik moet|moet ik|ik wil|liever)\b.{0,50}\b(?:niet|geen)\b|\bonvoldoende (?:informatie|gegevens)|\bgeen antwoord|\b(?:context|tekst|passages|fragmenten)\b.{0,40}\b(?:niet|niets|geen|onvoldoende)\b|\bniet (?:beantwoorden|te beantwoorden|te bepalen)|\bniet genoeg informatie""",
    "sv": r"""
        \b(?:jag kan|kan jag|jag vill|jag måste|tyvärr)\b.{0,50}\b(?:inte|avstå)\b|\botillräcklig(?:a|t)? (?:information|uppgifter|underlag)|\binget svar|\b(?:texten|texterna|sammanhanget|utdragen|avsnitten)\b.{0,40}\b(?:inte|inget|ingenting)\b|\binte tillräckligt""",
    "da": r"""
        \b(?:jeg kan|kan jeg|jeg vil|jeg må|desværre)\b.{0,50}\b(?:ikke|afstå)\b|\butilstrækkelige? (?:oplysninger|information)|\bintet svar|\b(?:teksten|teksterne|konteksten|uddragene|afsnittene)\b.{0,40}\b(?:ikke|intet)\b|\bikke nok (?:oplysninger|information)""",
    "pl": r"""
        \bnie (?:mogę|jestem w stanie|potrafię|chcę|będę|wiem)\b|\bwolę nie|\bmuszę odmówić|\bniewystarczające (?:informacje|dane)|\bza mało (?:informacji|danych)|\bbrak (?:odpowiedzi|informacji|danych)|\b(?:kontekst|tekst|fragmenty)\b.{0,40}\bnie\b|\bnie (?:da się|można) (?:ustalić|odpowiedzieć|określić)""",
    "tr": r"""
        yanıtlayam|cevaplayam|cevap verem|yanıt verem|yardımcı olam|yetersiz bilgi|bilgi yetersiz|yeterli bilgi (?:yok|içerm|bulunm)|belirlenem|söyleyem|yanıt verilem|cevap verilem|bahsetmiyor|bahsedilm|yorum yapm""",
    "id": r"""
        \b(?:saya )?tidak (?:dapat|bisa|mampu) (?:menjawab|membantu|ditentukan|dijawab|memberikan)|\bmaaf\b.{0,40}\btidak\b|\binformasi tidak (?:cukup|memadai)|\btidak (?:cukup|memuat|menyebutkan|mengandung)\b.{0,20}(?:informasi|hal)|\btidak ada jawaban""",
    "ru": r"""
        \bне (?:могу|смогу|получится|в состоянии|буду|стану|знаю)\b|воздержусь|воздерживаюсь|вынужден(?:а)? отказать|недостаточно (?:сведений|данных|информации)|(?:данных|сведений|информации) недостаточно|ничего не (?:сказано|говорится)|нет (?:ответа|сведений|данных)|не (?:упоминается|содержит|содержится)|ответить невозможно|нельзя (?:ответить|определить|установить)|затрудняюсь""",
    "uk": r"""
        \bне (?:можу|зможу|вдасться|буду|знаю)\b|утримаюсь|утримаюся|недостатньо (?:відомостей|даних|інформації)|(?:даних|відомостей|інформації) недостатньо|нічого не (?:сказано|йдеться)|немає (?:відповіді|відомостей|даних)|не (?:згадується|містить)|неможливо (?:відповісти|визначити)""",
    "el": r"""
        δεν (?:μπορώ|μπορεί|είμαι σε θέση|γνωρίζω|επαρκούν|αναφέρ|περιέχ)|ανεπαρκ|δεν υπάρχ|προτιμώ να μην|καμία απάντηση|λυπάμαι""",
    "ar": r"""
        لا (?:أستطيع|يمكنني|يمكن|أعرف|أعلم|تذكر|يذكر|تحتوي|يحتوي)|لست قادر|معلومات غير كافية|غير كافية|عذرا|آسف|أفضل عدم|أعتذر|لا توجد (?:إجابة|معلومات)""",
    "fa": r"""
        نمی.?توانم|نمی.?دانم|قادر نیستم|اطلاعات (?:کافی|ناکافی)|کافی نیست|متاسفم|متأسفم|ترجیح می.?دهم|پاسخی (?:نمی|وجود)|نمی.?توان""",
    "hi": r"""
        नहीं (?:दे सकता|दे सकती|कर सकता|बता सकता|दिया जा सकता|कहा जा सकता)|उत्तर (?:देना संभव नहीं|नहीं)|जानकारी (?:पर्याप्त नहीं|अपर्याप्त)|पर्याप्त जानकारी नहीं|माफ|क्षमा|उल्लेख नहीं|असमर्थ""",
    "zh": r"""
        我(?:们)?(?:也|并)?不(?:知道|清楚)|无法(?:回答|确定|作答|得出|判断|提供|协助|帮助|处理)|不能(?:回答|协助|帮助|提供|确定)|不便(?:作答|回答|评论)|没有(?:提到|提及|足够|相关|说明)|信息不足|未(?:提及|提到|说明)|不足以|抱歉|很遗憾|(?:^|我|，|。)拒绝(?:回答|作答)|不予(?:回答|置评)""",
    "ja": r"""
        (?:回答|お答え|答える|判断|お応え|お手伝い|対応)(?:は|が|を|こと|する|し|いた)?.{0,6}(?:できません|出来ません|できない|かねます|控えます|ありません|いたしません)|情報が(?:不足|足り)|十分な情報.{0,6}(?:ません|ない)|記載(?:が|は)?.{0,3}(?:ありません|ない)|申し訳|わかりません|分かりません""",
    "ko": r"""
        (?:답변|대답|답|도움|도와|도울|판단|확인)\S*.{0,12}(?:없습니다|없어요|없다|못합니다|어렵습니다|않겠습니다)|정보가.{0,8}(?:부족|없)|죄송|알 수 없|언급(?:되지|이|하지)|삼가""",
    "th": r"""
        ไม่สามารถ|ไม่มีข้อมูล|ข้อมูลไม่(?:เพียงพอ|พอ)|ขออภัย|ขอโทษ|ไม่ทราบ|ไม่ได้(?:กล่าว|ระบุ)|ขอไม่|ตอบไม่ได้""",
}
# Wordings that an answer follows, although something like a refusal stands before.
POINTS_TO = r"points? to|deutet|hindeutet|apunta|indiqu|indica\b|aponta|указыва|вказу|wskazuj|wijst|tyder|işaret|mengarah|指向|示して|가리|δείχν"


def _all() -> re.Pattern:
    parts = []
    for wording in WORDINGS.values():
        parts += [p.strip() for line in wording.strip().splitlines() for p in _split(line)]
    return re.compile("|".join(f"(?:{p})" for p in parts if p))


def _split(line: str) -> list[str]:
    return line.strip().split(" | ")


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the strokes that no bracket holds."""
    parts, depth, at, start = [], 0, 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = pattern.index("]", at + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*parts, pattern[start:]]


def _any(pattern: re.Pattern) -> re.Pattern:
    """Found wherever ``pattern`` is, though not with the same end: what begins at a word's edge is tried only there."""
    edge, other, todo = [], [], [pattern.pattern]
    while todo:
        for p in _alternatives(todo.pop()):
            inner = p[3:-1]
            if p.startswith("(?:") and p.endswith(")") and all(_balanced(x) for x in _alternatives(inner)):
                todo.append(inner)
            elif p.startswith("\\b"):
                edge.append(p[2:])
            else:
                other.append(p)
    parts = [r"\b(?:" + "|".join(edge) + ")"] * bool(edge) + other
    return re.compile("|".join(parts))


def _balanced(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


PATTERN = _all()
#: Whether a text has any of the wordings at all.
ANYWHERE = _any(PATTERN)
#: The same for Arrow, wherever words begin and end: it tells edges of words in ASCII only.
_LOOSE = PATTERN.pattern.replace("\\b", "")
POINTING = re.compile(POINTS_TO)


def may_decline(texts: list[str]) -> list[bool]:
    """For each text whether it may hold any of the wordings; where not, it holds none."""
    low = pa.array([t.lower().encode("utf-8", "replace") for t in texts], pa.binary()).view(pa.string())
    return pc.match_substring_regex(low, _LOOSE).to_pylist()


def declines(sentence: str) -> bool:
    """Whether a sentence's wording declines; who is named in it is for the caller to look at."""
    low = sentence.lower()
    return ANYWHERE.search(low) is not None and POINTING.search(low) is None
