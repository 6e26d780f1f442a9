"""Marks for values, filler, error pages and script notices."""

from __future__ import annotations

import pytest

from skyloom.llm.residue import judge


@pytest.mark.parametrize(
    "text",
    [
        "The half cone of Sensor36 was set to {0} degrees.",
        "Ballistic target m{0} has an epoch offset of 3 s.",
        "重访间隔平均{0}小时，最大值出现在普克岛。",
        "The pass lasted {0:.1f} s.",
        "The pass lasted {{0}} s.",
        "差异主要来自（此处补充原因）。",
        "The revolution produced 238 access records, (此处补充数目) of them by Sensor32.",
        "该窗口由（此处补充：卫星名）承担。",
        "仿真步长取«step»秒，场景起点为«start_time»。",
        "Gridun carries priority 8; its last visit lies « revisit » hours back.",
        "«卫星名»进入上空。",
    ],
)
def test_marks_for_values(text):
    assert judge(text) == "placeholder"


@pytest.mark.parametrize(
    "text",
    [
        "In the export {0} stands for the number of the satellite.",
        "约定用（此处补充原因）代表待写的部分。",
        "The mark «step» is replaced by the step of the simulation.",
        r"The id of a satellite matches Satellite\d{3} and its date [0-9]{4}, an area is x^{2}.",
        "该窗口被推迟（此处补充说明：地面站排程冲突，改由备份星承担）。",
        "Спутник «Сокол» и «Satellite111» прошли над целью.",
    ],
)
def test_no_marks_for_values(text):
    assert judge(text) is None


ERROR_HEADS = (
    "404 Not Found", "The page you asked for could not be located.", "This record is no longer available.", "HTTP 403 - Forbidden",
    "Access to this pass report was denied. You do not have the needed role.", "Session expired. Sign in again to see the board.",
    "Too many requests. Slow down and reload in 30 seconds.", "Oops! Something broke while this report was loading.", "503 Service Unavailable",
    "Gateway timeout", "Connection to the catalog was refused.", "Bad request: query parameter is missing.", "Error code ERR-304",
    "抱歉，页面走丢了", "您访问的页面不存在或已被移走。", "该报告已被删除或暂不可用。", "403 没有访问权限", "服务器内部错误。", "502 网关错误",
    "请求超时（504），网关没有收到响应。", "访问过于频繁，请30秒后再来。", "会话已过期，请重新登录。", "系统维护中，预计184分钟后恢复。",
    "数据加载失败，点击重试", "连接数据库失败：ERR-304", "出错了（错误码 186）", "Diese Seite wurde nicht gefunden (404).",
    "Der Dienst ist zurzeit nicht erreichbar.", "Страница не найдена. Ошибка 404.", "ページが見つかりません。",
)
FILLER_HEADS = (
    "Placeholder paragraph. Your report text here.", "Type something. Sample text goes here.", "Body copy will follow once the template is approved.",
    "Content to be added later.", "This section is intentionally a dummy for layout checks.", "（本段为占位段落，发布前请删除）", "内容待补充",
    "正文整理中，稍后上传。", "这里写过境简报的正文，先空着。",
)
SCRIPT_HEADS = (
    "Please enable JavaScript and reload the page.", "JavaScript seems to be off in your browser; allow it in order to open this report.",
    "Turn JS on to view the visibility board.", "Checking your browser. Your browser blocks scripts.", "Scripting is required for the full view.",
    "This app does not work without scripting. Switch it on before the map can be shown.", "noscript: the viewer is script based. Permit them to continue.",
    "此页面需要启用 JavaScript，以便查看完整报告。", "检测到脚本被拦截，当前无法加载内容。", "当前环境无法执行 JS，然后重新打开看板。",
    "您的浏览器不支持脚本，或脚本功能已被关闭，请调整设置后刷新页面。", "本站依赖脚本运行才能显示。", "请先打开浏览器的脚本功能，当前无法加载内容。",
    "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Включите поддержку сценариев в браузере, чтобы увидеть карту.",
    "このページを表示するにはJavaScriptを有効にしてください。",
)
CLOSINGS = (
    "", "It may have moved or its name may have changed.", "Check the address and try once more.", "The team was informed.",
    "Please come back in a few minutes.", "If this keeps happening, write to the desk.", "请检查地址是否正确。", "请稍后重试。", "错误已记录。", "我们正在处理。",
    "如仍无法打开，请联系值班员。",
)


@pytest.mark.parametrize("closing", CLOSINGS)
@pytest.mark.parametrize("head", ERROR_HEADS + FILLER_HEADS + SCRIPT_HEADS)
def test_every_head_with_every_closing(head, closing):
    kept = [
        page
        for gap in ("\n", " ", "")
        for before in ("", "Constellation board\n", "Visibility console — ", "首页 | 星座 | 目标 | 报表\n")
        for after in ("", "\n返回上一页", "\nBack to the start page", "\n参考编号 8c6243")
        if judge(page := f"{before}{head}{gap}{closing}{after}") is None
    ]
    assert not kept


def test_real_text_with_a_contact_line():
    text = "Satellite122在7月8日进入普克岛上空，可见时长708秒，最大仰角53.6度。传感器标定完成，转入人工复核。如有疑问，请联系值班员。"
    assert judge(text) is None


MENU = "Home > Passes > Detail > Overview of all satellites, windows, targets, clusters, sensors and reports of the visibility console"


@pytest.mark.parametrize(
    ("body", "kind"),
    [
        ("The page you asked for could not be located.", "error"),
        ("Oops! Something broke while this report was loading.", "error"),
        ("服务器内部错误。 请稍后重试。", "error"),
        ("This app does not work without scripting. Switch it on before the map can be shown.", "script"),
        ("Lorem ipsum Aliquet tempore magnus velo elit non lorem magnus in ferre.", "filler"),
        ("Placeholder paragraph. Your report text here.", "filler"),
    ],
)
def test_short_body_under_long_menus_and_footers(body, kind):
    footers = "\n".join(f"Copyright {year} the operators of the ground segment and the planning desk of the constellation" for year in range(2015, 2026))
    assert judge(f"{MENU}\n{MENU}\n{body}\n{footers}") == kind


def test_real_text_under_long_menus():
    assert judge(f"{MENU}\n{MENU}\nThe half cone of Sensor36 was set to 30 degrees and the swath changed with it.\n{MENU}") is None


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("HTTP 418: we could not process that. Try again later.", "error"), ("This site relies on JS; switch it on to proceed.", "script"), ("Página no encontrada. Inténtelo de nuevo.", "error"),
        ("Página não encontrada. Tente novamente.", "error"), ("페이지를 찾을 수 없습니다. 다시 시도해 주세요.", "error"), ("Pagina non trovata. Riprova.", "error"), ("Habilite JavaScript para ver esta página.", "script"),
        ("Neque porro quisquam est qui dolorem ipsum quia dolor sit amet", "filler"), ("重访间隔平均#revisit#小时。", "placeholder"), ("采样距离约{分辨率}米。", "placeholder"),
    ],
)
def test_forms_outside_the_test_tables(text, kind):
    assert judge(text) == kind


@pytest.mark.parametrize(
    "text",
    [
        "The server answered with 503 last night; after the restart all passes were sent again.", "In this manual {name} stands for the name of the operator.", "The status bar shows the words lorem ipsum as an example of filler.",
        "The set {1, 2, 3} holds three satellites.", "Use printf with %(name)s in the mask for names.", "La estación de Madrid observa el satélite y envía los datos por la tarde.",
        "Der Satellit überflog die Station und sendete 40 Bilder.", "Alpha Centauri est stella proxima, 4 lux annis distat: numerus 7 observatus.", "",
    ],
)
def test_sound_texts_outside_the_test_tables(text):
    assert judge(text) is None


def test_table_with_nulls_copies_and_clashing_names():
    from skyloom.llm.residue import exclude_residue, find_residue
    from skyloom.session import local_session

    rows = [(1, "404 Not Found", "x"), (1, "404 Not Found", "x"), (2, None, "x"), (3, " ", None), (None, "Lorem ipsum dolor sit amet", "x"), (4, " ".join(f"Pass {n} took {n % 7} minutes." for n in range(20_000)), "x")]
    spark = local_session(4, 4)
    table = spark.createDataFrame(rows, "doc_id long, text string, residue string")
    assert sorted((r[0] or 0, r[1]) for r in find_residue(table, "doc_id", "text").filter("residue is not null").collect()) == [(0, "filler"), (1, "error"), (1, "error")]
    assert exclude_residue(table, "doc_id", "text").filter("doc_id = 1").count() == 0
    assert find_residue(table.limit(0), "doc_id", "text").collect() == []
