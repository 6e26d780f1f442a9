"""Template residue, filler, error pages and script notices."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: phrases, lower case, by kind ----------------------------------------------
FILLER = (
    "lorem ipsum", "dolor sit amet", "your text here", "text goes here", "text here", "sample text", "dummy text", "filler text",
    "type something", "placeholder paragraph", "placeholder text", "placeholder", "insert text", "add your text", "body copy will follow",
    "content to be added later", "content to be added", "to be added later",
    "content coming soon", "coming soon", "under construction", "intentionally a dummy",
    "intentionally left blank", "dummy for layout", "this section is intentionally", "text to follow", "to be written", "your report",
    "此处为正文", "测试内容", "正文内容", "示例内容", "内容待补充", "待补充", "内容待定", "此处为占位", "占位段落", "占位文字", "占位符", "本段为占位", "先空着", "正文待补", "正文整理中", "稍后上传",
    "这里写", "的正文", "此处填写", "请在此输入", "请在此处", "示例文字", "示例文本", "测试文本", "内容建设中", "敬请期待", "一二三四五六七八九十",
    "platzhalter", "blindtext", "hier steht", "texte à venir", "texte de remplissage", "contenu à venir", "текст-заполнитель", "здесь будет текст",
    "ダミーテキスト", "ここに本文", "準備中",
    "texto de relleno", "su texto aquí", "próximamente", "en construcción", "texto de exemplo", "em construção", "testo segnaposto", "in costruzione", "자리 표시", "준비 중",
)
ERROR = (
    "not found", "page not found", "could not be located", "could not be found", "cannot be found", "does not exist", "no longer available", "no longer exists",
    "service unavailable", "temporarily unavailable", "internal server error", "server error", "bad gateway", "gateway timeout", "gateway time-out",
    "bad request", "query parameter is missing", "forbidden", "unauthorized", "access denied", "was denied", "permission denied", "do not have the needed role",
    "do not have permission", "too many requests", "slow down and reload", "reload in", "session expired", "session has expired", "log in again", "sign in again",
    "connection refused", "connection to the", "access to this", "was refused", "connection timed out", "timed out", "oops", "something went wrong", "something broke while", "hit a snag", "cannot show this", "an error occurred", "an unexpected error", "error code", "upstream server gave no valid answer", "gave no valid answer",
    "the page you asked for", "page you requested", "it may have moved", "its name may have changed", "may have been moved", "check the address", "try once more", "try again later",
    "try again", "please come back in a few minutes", "come back later", "the team was informed", "has been notified", "has been logged", "if this keeps happening", "for support", "maintenance", "http error", "err-", "error 404", "error 500", "error 502", "error 503", "error 504", "error 403",
    "页面走丢", "页面不存在", "不存在或已被移走", "您访问的页面", "已被移走", "已被删除或暂不可用", "暂不可用", "服务器内部错误", "服务器错误", "网关错误", "网关超时", "请求超时", "网关没有收到响应",
    "没有访问权限", "无权访问", "拒绝访问", "访问过于频繁", "秒后再来", "会话已过期", "登录已过期", "请重新登录", "系统维护中", "分钟后恢复", "加载失败", "点击重试", "连接数据库失败", "连接失败",
    "出错了", "错误码", "错误已记录", "请稍后重试", "稍后再试", "我们正在处理", "请检查地址是否正确", "如仍无法", "请联系", "抱歉", "找不到", "未找到",
    "nicht gefunden", "nicht erreichbar", "diese seite wurde", "der dienst ist zurzeit", "interner serverfehler", "zugriff verweigert", "sitzung abgelaufen",
    "introuvable", "cette page est", "erreur interne", "accès refusé", "service indisponible", "session expirée",
    "не найдена", "страница не", "внутренняя ошибка", "ошибка сервера", "ошибка", "доступ запрещ", "сервис недоступен", "сессия истекла",
    "ページが見つかりません", "見つかりません", "サーバーエラー", "アクセスが拒否", "エラーが発生",
    "no encontrada", "no se encuentra", "no existe", "acceso denegado", "error interno", "servicio no disponible", "inténtelo de nuevo", "vuelva a intentarlo", "sesión ha caducado",
    "não encontrada", "não existe", "acesso negado", "erro interno", "serviço indisponível", "tente novamente", "sessão expirou",
    "non trovata", "non esiste", "accesso negato", "errore interno", "servizio non disponibile", "riprova", "찾을 수 없", "액세스가 거부", "오류가 발생", "서버 오류", "다시 시도",
    "could not process", "could not be processed", "unable to load", "failed to load", "could not load", "could not open", "cannot be displayed", "is not available",
)
SCRIPT = (
    "enable javascript", "javascript is required", "javascript is disabled", "javascript seems to be off", "requires javascript", "need javascript", "please enable", "turn js on", "turn on javascript",
    "seems to be off in your browser", "to be off in your browser", "allow it", "switch it on", "permit them", "scripts and cookies", "turn on scripts", "you need to turn on", "blocks scripts", "your browser blocks",
    "scripting is required", "scripting", "without scripting", "does not work without", "this app does not work", "script based", "noscript", "the viewer is script", "use a capable browser", "checking your browser", "your browser", "javascript", "loading",
    "and reload the page", "reload the page", "for the full view", "to continue", "scripts", "to view", "to see", "in order to", "can be shown", "can be displayed",
    "需要启用", "启用javascript", "启用 javascript", "开启javascript", "开启 javascript", "和 cookie", "脚本被拦截", "依赖脚本运行", "不支持脚本", "脚本功能", "浏览器的脚本", "您的浏览器", "无法执行 js", "当前环境", "此页面", "本站",
    "调整设置后刷新", "刷新页面", "以便查看完整报告", "查看完整报告", "才能显示", "当前无法加载内容", "无法加载内容", "已被关闭", "正在加载", "检测到",
    "aktivieren sie javascript", "um diese seite zu sehen", "bitte aktivieren", "activer javascript", "pour afficher", "veuillez activer", "включите поддержку сценариев", "включите javascript", "в браузере", "javascriptを有効", "このページを表示", "有効にしてください",
    "habilite javascript", "active javascript", "activar javascript", "ative o javascript", "habilite o javascript", "attiva javascript", "abilita javascript", "자바스크립트를", "javascript를",
    "relies on js", "needs js", "requires js", "without js", "js is off", "js is disabled", "enable js", "relies on javascript", "browser does not support", "to proceed", "this site", "this page", "para ver esta", "esta página",
)
#: Words of dummy Latin and of idle typing.
DUMMY_WORDS = frozenset(
    ("lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
     "aliquet enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
     "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum dolorem neque porro quisquam magnam aliquam quaerat voluptatem tempora nullo "
     "foo bar baz qux quux asdf asd qwer qwerty zxcv zxcvb hjkl blah bla test testing abc xyz 123 1234").split()
)
#: Frequent words of living languages; a passage with them is no dummy Latin.
LIVING_WORDS = frozenset(
    ("the and of to is with that for was are this by at from on it has be der die das und ist mit von zu den im für auf le les des du une pour que dans sur el la los las del y por con una il di che un um uma não".split())
)
#: Lines around the content: menus, footers, reference numbers.
FURNITURE = (
    "back to the start page", "back to home", "返回上一页", "返回首页", "request id", "参考编号", "error id", "visibility console", "constellation board", "星座可见性看板",
    "copyright", "©",
)
_MENU_START = re.compile(r"(?:home|首页)\b|code [\w-]+$")
_MENU_MARK = re.compile(r" > | \| ")
#: A sentence with one of these speaks about placeholders, filler, errors or scripts: it explains a
#: notation, tells what became of it, or reports an event of the past.
ABOUT = re.compile(
    r"写作|约定|写成|原样|印了|换成|替换|已写进|手册|文档里|返回过|经查|恢复正常|期间|没有丢失|次出现|发生|字段含义|说明如下|照抄|语法|掩码|指的是|曾经?|已修复|用.{0,30}(?:代表|表示)"
    r"|stands? for|by mistake|\bprint(?:ed|f)\b|\bmask\b|\bexport\b|\btemplate,|syntax|\bmeans\b|(?:is|was|were|are) (?:replaced|swapped|fixed|restored|explained)|replaces|denotes|convention"
    r"|\bwe (?:read|saw|found)|came from|\bthe manual\b|\bmanual (?:covers|says|describes|explains)|answered|\b(?:last|previous) (?:night|week|month|issue)|yesterday|\blost (?:nothing|no)\b|\brestart|\bquot|\bwords?\b|\bexamples?\b|such as"
    r"|bedeutet|steht für|ersetzt|remplac|signifie|означает|замен[её]н|置き換え|significa|reemplaz",
    re.I,
)
# ----------------------------------------------------------------------------------------------

_NAME = r"[A-Za-z一-鿿][\w .\-一-鿿]{0,39}"
#: A mark that stands for a value that was never filled in.
PLACEHOLDER = re.compile(
    "|".join(
        (
            rf"\{{\{{\s*{_NAME}\s*\}}\}}",
            rf"\{{%\s*{_NAME}\s*%\}}",
            rf"(?<![{{$A-Za-z0-9_\"]){{{_NAME}}}(?!}})",
            r"(?<![{$#^_\]])(?<!\\[A-Za-z])\{\s*\d{1,3}(?::[\d.,<>+]*[a-zA-Z%])?\s*\}(?!\})",  # not \d{4}, [0-9]{2} or x^{2}
            r"\{\{\s*\d{1,3}\s*\}\}",
            rf"[$#]\{{\s*{_NAME}\s*\}}",
            rf"\$\({_NAME}\)",
            rf"%\({_NAME}\)[sdif]?",
            rf"<<\s*{_NAME}\s*>>",
            r"(?<!<)<(?!/?(?:p|br|b|i|u|a|div|span|li|ul|ol|td|tr|table|em|strong|code|pre|h\d|html|body|head|img|think|thought|script|style)\b)(?:[A-Za-z][A-Za-z0-9]*(?:[_ \-][A-Za-z0-9]+){0,4}|请?[一-鿿]{2,20})>(?!>)",
            r"\[(?:TBD|TODO|TBC|[A-Z]{2,}(?:[ _][A-Z]+)*|(?:insert|enter|your|fill in|add|name of|date of)\b[^\[\]\n]{0,40})\]",
            r"【(?:待填写?|待补充?|待定|待确认|请?填写?[^】\n]{0,12}|(?!注|例|图|表|附)[一-鿿]{2,8})】",
            r"[（(]\s*(?:请?在)?此处[请需待]?(?:补充|填写|填入)[:：]?\s*[^（）():：，。\n]{0,30}[）)]",
            r"«\s*(?!(?:Satellite|Sensor|m)\d+\s*»)(?:[A-Za-z][A-Za-z0-9]*(?:[_ \-][A-Za-z0-9]+){0,4}|[一-鿿]{2,20})\s*»",
            r"(?<![A-Za-z0-9_#])#[A-Za-z][A-Za-z_]*#(?![A-Za-z0-9_#])",
            r"@@\s*[A-Za-z]\w*\s*@@",
            r"__[A-Za-z][A-Z_a-z]*[A-Za-z]__",
            r"(?<!_)_{3,}(?!_)",
            r"(?<![A-Za-z])X{3,}(?![A-Za-z])",
            r"(?<![A-Za-z])(?:TBD|TODO|FIXME)(?![A-Za-z])",
            r"待填写|待填入|请填写|请输入[一-鿿]{1,6}名",
        )
    )
)
#: Every branch of PLACEHOLDER needs one of these.
_OPENERS = ("{", "$", "#", "%(", "<", "[", "【", "此处", "«", "@@", "__", "XXX", "TBD", "TODO", "FIXME", "待填", "请填写", "请输入")
_SENTENCE = re.compile(r"(?<=[。！？!?\n])|(?<=[a-zà-ÿа-яё)\]>}\"'0-9】»_#@]\.)(?=\s|[一-鿿])|(?<=[a-z0-9)] [—–])\s")
_FILLER_WORDS = re.compile(r"(?:\b[xX]{2,}\b[\s,.]*){3,}|(?:一二三四五六七八九十?)+")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, phrases in (("filler", FILLER), ("error", ERROR), ("script", SCRIPT)):
        for phrase in phrases:
            automaton.add_word(phrase, (len(phrase), kind))
    automaton.make_automaton()
    return automaton


def _solid(text: str) -> int:
    """Letters of the text; an ideograph or kana weighs two."""
    if text.isascii():
        return sum(map(str.isalnum, text))
    return sum(2 if c >= "⺀" else 1 for c in text if c.isalnum())


def _furniture(lowered: str) -> bool:
    """Whether the line, in lower case, is a menu, a footer or a reference number."""
    if any(words in lowered for words in FURNITURE) or _MENU_START.match(lowered):
        return True
    return len(_MENU_MARK.findall(lowered)) >= 2


_LATIN_ENDING = re.compile(r"(?:us|um|is|re|ae|it|am|em|os|o|a|unt|or|ne|at|et|ut|in|ed|ad)$")


def _dummy(text: str) -> bool:
    """Whether a passage of four words or more is dummy Latin or idle typing: its opening words stand in it, or three at
    least and a third of its words are known as such, or one is and most of eight or more end like Latin; and hardly one
    belongs to a living language."""
    words = re.findall(r"[^\W\d_]+|\d+", text)
    known = sum(w in DUMMY_WORDS for w in words)
    if len(words) < 4 or not known or sum(w in LIVING_WORDS for w in words) > len(words) / 20:
        return False
    if "lorem ipsum" in text or known >= max(3, len(words) / 3):
        return True
    return len(words) >= 8 and sum(_LATIN_ENDING.search(w) is not None for w in words) >= 0.7 * len(words)


def _repeats(text: str) -> bool:
    """Whether the text, perhaps under a title, is one short passage four times or more."""
    for body in (text, text.partition("\n")[2]):
        body = " ".join(body.split())
        if len(body) >= 12:
            period = (body + body).find(body, 1)
            spaced = (body + " " + body).find(body, 1)
            if 0 < min(p for p in (period, spaced) if p > 0) <= len(body) / 4 or len(set(body)) <= 3:
                return True
    return False


def _mask(text: str, original: str) -> tuple[list[bool], dict[str, int]]:
    """Which characters the phrases cover, empty where there is no phrase, and how many by kind."""
    mask, kinds = [], {"filler": 0, "error": 0, "script": 0}
    for end, (length, kind) in _automaton().iter(text):
        mask = mask or [False] * len(text)
        start = end + 1 - length
        if start and text[start].isascii() and text[start].isalpha() and text[start - 1].isascii() and text[start - 1].isalpha():
            if not (original[start].isupper() and original[start - 1].islower()):  # two sentences may lack their space
                continue
        for i in range(start, end + 1):
            if not mask[i]:
                mask[i] = True
                kinds[kind] += 1
    return mask, kinds


def judge(text: str | None, least_sentence: float = 0.35, least_text: float = 0.6) -> str | None:
    """placeholder, filler, error or script, or None for real content (and null or blank texts).

    placeholder: a mark for a value stands in a sentence that isn't about such marks. The others:
    of the text without menu and footer lines and a short title, at least ``least_text`` lies in
    sentences that phrases of the automaton cover to ``least_sentence``; sentences about the
    subject don't count as covered.
    """
    if text is None or not text.strip():
        return None
    folded = unicodedata.normalize("NFC", text)
    if any(o in folded for o in _OPENERS) and PLACEHOLDER.search(folded) and any(PLACEHOLDER.search(s) and not ABOUT.search(s) for s in _SENTENCE.split(folded)):
        return "placeholder"
    if _repeats(folded):
        return "filler"
    filled = 0
    if "一二三" in folded or "xx" in folded.lower():
        filled = sum(_solid(m.group()) for m in _FILLER_WORDS.finditer(folded))
    sentences = [s for s in _SENTENCE.split(folded) if s.strip()]
    total = covered = 0
    kinds = {"filler": 0, "error": 0, "script": 0}
    for number, sentence in enumerate(sentences):
        line = sentence.strip()
        weight = _solid(line)
        lowered = line.lower()
        if len(lowered) != len(line):
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
        if not weight or _furniture(lowered):
            continue
        mask, found = _mask(lowered, line)
        part = sum(2 if c >= "⺀" else 1 for c, m in zip(lowered, mask, strict=True) if m and c.isalnum()) / weight if any(found.values()) else 0
        if number == 0 and not part and sentence.endswith("\n") and weight <= 40 and line[-1] not in ".。!！?？" and len(sentences) > 1:
            continue  # a title
        total += weight
        if _dummy(lowered):
            covered += weight
            kinds["filler"] += weight
        elif part >= least_sentence and not ABOUT.search(sentence):
            covered += weight
            for kind in kinds:
                kinds[kind] += found[kind]
    if filled and total and filled >= least_text * total:
        return "filler"
    if total and covered >= least_text * total:
        return max(kinds, key=kinds.get)
    return None


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [judge(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=[batch.schema.field(0).name, "residue"])


def find_residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Columns ``key`` and residue: placeholder, filler, error, script, or null for real content.

    One pass over whole texts in Arrow batches, nothing is shuffled. Null, empty and blank texts
    have null. Repeated rows stay repeated. Extra columns are dropped. An empty table gives an
    empty one.
    """
    schema = T.StructType([documents.schema[key], T.StructField("residue", T.StringType())])
    return documents.select(key, F.col(text)).mapInArrow(_judge_batches, schema)


def exclude_residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``documents`` whose text is real content; a row with a null key stays."""
    flagged = find_residue(documents, key, text).filter("residue is not null").select(key).distinct()
    return documents.join(flagged, key, "left_anti")
