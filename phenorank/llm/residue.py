"""Template residue and error pages: text with unfilled fields, and text that is nothing but filler, errors or script notices.

Unfilled fields are found by one grammar per delimiter. Code blocks are taken out first, and a field in a sentence
that talks about templates doesn't count unless fields stand densely or elsewhere too. Whether a text is nothing but
residue is settled line by line and sentence by sentence: the first unit with content of its own acquits it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.llm.lookalike import by_table

# The grammar of an unfilled field for each delimiter. A name is a few words of letters, digits and _.
NAME = r"[^\W\d_]\w*(?:(?:[.\-]|\s{1,3})\w+){0,4}"
LONG_NAME = r"[^\W\d_]\w+(?:(?:[.\-]|\s{1,3})\w+){0,4}"
VERBS = r"your|insert|enter|fill(?: in)?|add|type|select|choose|điền|nhập|chèn|ghi|insérer|saisir|remplir|compléter|votre|to be|tbd|todo|placeholder"
FIELDS: dict[str, str] = {
    "double braces": r"\{\{\{?\s{0,3}[#/&^]?[^{}\n]{1,80}?\s{0,3}\}\}",
    "dollar braces": rf"\$\{{\s?{NAME}\s?\}}",
    "hash braces": rf"#\{{\s?{NAME}\s?\}}",
    "block tag": r"\{%-?\s?\w[^{}%\n]{0,80}-?%\}",
    "braces": rf"(?<![{{$#\\\w]){{\s?{LONG_NAME}\s?}}(?!}})",
    "percent": r"(?<![\w%])%[^\W\d_]\w*(?:[.\- ]\w+){0,3}%(?![\w%])",
    "percent tuple": r"%\([^()\n]{1,60}\)[sdrf]",
    "server tag": r"<%[=\-#]?\s?[^<>%\n]{1,80}\s?%>",
    "double brackets": rf"\[\[\s?{NAME}\s?\]\]",
    "asking brackets": rf"\[\s?(?i:{VERBS})\b[^\[\]\n]{{0,60}}\]",
    "named brackets": r"\[[A-ZÀ-Ỹ]{2,}(?:_[A-ZÀ-Ỹ\d]+)+\]|\[[a-zà-ỹ]+(?:_[a-zà-ỹ\d]+)+\]",
    "double angles": rf"<<\s?{NAME}\s?>>",
    "asking angles": rf"<\s?(?i:{VERBS})\b[^<>\n]{{0,60}}>",
    "named angles": r"<[^\W\d_]+_\w+>",
    "guillemets": rf"«{NAME}»",
    "at signs": rf"@@\s?{NAME}\s?@@",
    "underscored": r"(?<!\w)__[^\W\d_]\w*?(?:[.\- ]\w+?){0,4}__(?!\w)",
    "dollars": r"(?<![\w$])\$[^\W\d_]\w*(?:[.\- ]\w+){0,3}\$(?![\w$])",
    "variable": r"(?<![\w$])\$[^\W\d_][\w.]{2,}\b",
    "hashes": r"(?<![\w#&])##?[^\W\d_]\w+(?:[.\-_]\w+){0,3}##?(?![\w#])",
    "to be decided": r"\b(?:TBD|TODO|TBC)\s?\([^()\n]{1,60}\)|(?<!\w)(?:TBD|TODO|TBC)(?!\w)",
    "line": r"_{4,}|\.{6,}|(?:\. ){5,}\.|…{3,}|-{2,}\s?\(blank\)",
    "date mask": r"(?i:(?<!\w)(?:dd|jj|mm|nn)([/.\-])(?:mm|dd|tt)\1(?:yyyy|yy|aaaa|nnnn)(?!\w))|(?<!\w)[Xx]{2}([/.\-])[Xx]{2}\2[Xx]{2,4}(?!\w)",
    "to be filled": (
        r"(?i:\(\s?(?:chưa điền|chưa nhập|chưa có|cần điền|điền sau|sẽ điền|bổ sung sau|để trống|to be (?:completed|filled(?: in| out)?|added|determined|confirmed|announced)"
        r"|not filled in|fill in|please complete|left blank|à compléter|à remplir|à renseigner|à préciser)\s?\))"
    ),
}
#: A text without a field's sign needn't be searched for it.
SIGNS: dict[str, tuple[str, ...]] = {
    "{{": ("double braces",),
    "${": ("dollar braces",),
    "#{": ("hash braces",),
    "{%": ("block tag",),
    "{": ("braces",),
    "%": ("percent",),
    "%(": ("percent tuple",),
    "<%": ("server tag",),
    "[[": ("double brackets",),
    "[": ("asking brackets", "named brackets"),
    "<<": ("double angles",),
    "<": ("asking angles", "named angles"),
    "«": ("guillemets",),
    "@@": ("at signs",),
    "__": ("underscored",),
    "$": ("dollars", "variable"),
    "#": ("hashes",),
    "TB": ("to be decided",),
    "TODO": ("to be decided",),
    "____": ("line",),
    "......": ("line",),
    ". . .": ("line",),
    "………": ("line",),
    "(blank)": ("line",),
    "(": ("to be filled",),
}
#: The middle of every date mask between its separators, in lower case: these signs hold for any case.
DATE_SIGNS = tuple(separator + middle + separator for separator in "/.-" for middle in ("mm", "dd", "tt", "xx"))
_FIELD = {name: re.compile(pattern) for name, pattern in FIELDS.items()}
_INLINE = re.compile(r"`[^`\n]+`")
_TUTORIAL = re.compile(
    r"\b(?:placeholders?|template (?:syntax|engine|language|variable)|syntax|tutorial|for example|e\.g\.|is written as|are written as|written in the form|in the format|the format|format is|variables? (?:called|named|like)|escap(?:e|ed|ing)"
    r"|cú pháp|ví dụ|định dạng|viết theo dạng|dưới dạng|biến mẫu|syntaxe|par exemple|au format|le format|gabarit)\b",
    re.I,
)

# Wording of page furniture, filler, errors and script notices, in lower case, for a whole line or sentence.
_FURNITURE = re.compile(
    r"[^|]{1,42}(?:\|[^|]{1,42}){1,9}|(?:©|\(c\)|copyright).{0,80}|all rights reserved|request id:? ?[\w\-]+|(?:back|return) to .{1,40}|go back\b.{0,60}|quay lại\b.{0,40}|về trang chủ"
    r"|trang chủ|retour\b.{0,40}|revenir\b.{0,40}|accueil|home|contact(?: us)?|liên hệ|menu|search|tìm kiếm|rechercher|log ?in|sign in|đăng nhập|connexion|help|skip to (?:main )?content"
    r"|(?:page|trang) \d+(?: ?(?:of|/|trên|sur) ?\d+)?|privacy(?: policy)?|terms of (?:use|service)|cookie (?:policy|settings)|share|print(?: this page)?|\W*"
)
_ERROR = re.compile(
    r"(?:http(?:/\d(?:\.\d)?)? ?)?(?:error )?[45]\d\d\b.{0,60}|(?:error|lỗi|erreur|exception|warning|fatal)(?: ?\(?(?:code )?\d+\)?)? ?[:–-].{0,140}|(?:error|lỗi|erreur) ?(?:code )?\d*"
    r"|(?:sorry, )?(?:we )?(?:could not|couldn't|cannot|can't|can not|failed to|unable to|impossible (?:de|d')) ?(?:be )?(?:find|open|load|fetch|render|decode|display|show|read|reach|connect|complete|process|retrieve|access|locate|trouver|ouvrir|charger|afficher)\b.{0,100}"
    r"|không (?:thể (?:mở|tải|hiển thị|tìm|đọc|kết nối|truy cập)|tìm thấy (?:trang|hồ sơ|báo cáo|tài liệu|tệp))\b.{0,80}"
    r"|(?:access|permission) (?:is )?denied\b.{0,80}|accès (?:refusé|interdit)\b.{0,60}|truy cập bị từ chối\b.{0,60}|you (?:do not|don't) have (?:permission|access|the right)\b.{0,100}|(?:bạn )?không có quyền\b.{0,80}|vous n'avez pas (?:la permission|le droit|accès|l'autorisation)\b.{0,80}"
    r"|(?:your |the |this )?session (?:has |is )?(?:expired|timed out|ended)\b.{0,60}|log in again\b.{0,60}|please (?:log|sign) in\b.{0,60}|phiên (?:làm việc|đăng nhập)? ?(?:đã )?hết hạn\b.{0,60}|(?:mời|vui lòng|xin) đăng nhập\b.{0,60}|votre session\b.{0,60}|veuillez vous (?:re)?connecter\b.{0,60}"
    r"|oops\W*|(?:oops\W+)?something went wrong\b.{0,80}|an? (?:unexpected |unknown |internal )?error (?:has )?occurred\b.{0,80}|đã (?:xảy ra|có) lỗi\b.{0,80}|une erreur (?:est survenue|s'est produite)\b.{0,80}"
    r"|(?:please )?(?:try again|retry)\b.{0,60}|(?:vui lòng )?thử lại\b.{0,40}|(?:veuillez )?réessayer\b.{0,40}|too many requests\b.{0,60}|slow down\b.{0,60}|rate limit\b.{0,60}"
    r"|(?:the )?(?:service|server|site|system|page|resource) (?:is )?(?:temporarily |currently )?(?:unavailable|down|offline|under maintenance|not available)\b.{0,80}|(?:hệ thống|máy chủ|trang) (?:đang|tạm) (?:bảo trì|ngừng|quá tải)\b.{0,80}|(?:le )?(?:service|site|serveur) (?:est )?(?:temporairement )?(?:indisponible|en maintenance)\b.{0,80}"
    r"|(?:the )?(?:page|file|report|record|document|resource) you (?:are looking for|requested|asked for)\b.{0,100}|the requested (?:page|file|report|record|document|resource|url)\b.{0,100}|la page (?:demandée|que vous)\b.{0,80}|trang bạn (?:yêu cầu|tìm)\b.{0,80}"
    r"|(?:page |file |report )?not found|bad gateway|bad request|forbidden|unauthori[sz]ed|internal server error|gateway time-?out|request time-?out|the upstream\b.{0,80}|connection (?:refused|reset|timed out)\b.{0,60}"
    r"|traceback \(most recent call last\):?|file \"[^\"]*\", line \d+.{0,80}|[\w.]*(?:error|exception)(?:: .{0,100})?|at [\w.$<>]+\([^()]*\)|caused by: .{0,120}|segmentation fault.{0,40}|\{ ?\"(?:status|error|code|message|errors|detail|success)\" ?:.{0,300}\}"
)
_SCRIPT = re.compile(
    r"(?:please )?(?:enable|activate|turn on|allow|switch on) (?:javascript|java script|scripts?|scripting|cookies)\b.{0,120}|(?:vui lòng|hãy|xin|bạn cần) (?:bật|kích hoạt|cho phép) (?:javascript|tập lệnh|cookie|script)\b.{0,120}|(?:veuillez|merci d')? ?activer (?:javascript|les scripts|les cookies)\b.{0,120}"
    r"|(?:this|the|our) (?:\w+ ){0,3}(?:requires?|needs?|uses?|relies on) (?:javascript|scripts?|cookies)\b.{0,120}|turn (?:them|it|javascript|scripts) on\b.{0,80}|we(?:'|’)?re sorry,? but\b.{0,160}|you need (?:to enable|to turn on|a (?:modern )?browser|javascript)\b.{0,120}"
    r"|noscript\b.{0,120}|<noscript>.{0,160}|checking your browser\b.{0,100}|trình duyệt\b.{0,40}\b(?:chặn|không hỗ trợ|đã tắt|chưa bật)\b.{0,100}|votre navigateur\b.{0,120}|your browser (?:does not|doesn't|is|has|blocks|must)\b.{0,120}|javascript (?:is|must be|has been|seems|appears|est|đang|cần|bị)\b.{0,100}"
    r"|(?:this )?content is loaded dynamically\b.{0,80}|(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?human\b.{0,60}|loading(?:\.{3}|…)?|đang tải(?:\.{3}|…)?|chargement(?:\.{3}|…)?"
)
_FILLER = re.compile(
    r"(?:\w+ ){0,4}goes here\b.{0,60}|(?:your|add|insert|enter|place|type) (?:\w+ ){0,3}here|replace (?:this|me|the)\b.{0,80}|(?:this is )?(?:a |some )?(?:sample|dummy|placeholder|filler|example) (?:text|content|paragraph|copy)\b.{0,80}|(?:text|content) to be (?:added|replaced)\b.{0,40}"
    r"|nội dung (?:mẫu|giữ chỗ|tạm)\b.{0,60}|(?:đoạn văn|văn bản|đoạn|chữ) (?:giữ chỗ|mẫu|tạm)\b.{0,60}|tiêu đề (?:mẫu|phụ|ở đây)\b.{0,40}|texte (?:provisoire|d'exemple|de remplissage|factice|à remplacer)\b.{0,60}|contenu (?:à venir|provisoire|d'exemple)\b.{0,40}"
    r"|x{3,}(?:\W+x{3,})*\W*|(?:asdf|qwer|qwerty|zxcv|hjkl|jkl|asd|blah|bla|foo|bar|baz|test|testing)(?:\W+(?:asdf|qwer|qwerty|zxcv|hjkl|jkl|asd|blah|bla|foo|bar|baz|test|testing))+\W*|(\w+)(?:[ ,]+\1){2,}\W*|click (?:here )?to (?:edit|add)\b.{0,60}|coming soon|edit this (?:text|block|paragraph)\b.{0,40}|(?:sub)?(?:heading|title)(?: \d+)?"
)
# The words of the usual Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo"
    " consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Anything but ASCII, composed Latin letters and common punctuation.
_ODD = re.compile("[^\x00-\xac\xae-\u024f\u1e00-\u1eff\u2013-\u2014\u2018-\u201f\u2022\u2026\u2030-\u203a\u20ac\u2122]")
#: A label with a running number, where it is no error.
_NUMBERED = re.compile(r"(?:[^\W\d_]+ ){1,3}#?\d+")
_UNIT = re.compile(r"[^\n\r]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"\w+")


def _even(text: str) -> str:
    """One spelling per line, where a text has odd characters."""
    if text.isascii() or not _ODD.search(text):
        return text
    return "\n".join([line if line.isascii() else by_table(line) for line in text.splitlines()])


def _without_pairs(text: str, mark: str) -> str:
    """``text`` without what stands between two marks; an unpaired last mark opens nothing."""
    if mark not in text:
        return text
    parts = text.split(mark)
    odd = len(parts) % 2 == 0
    kept = parts[::2] + [mark + parts[-1]] if odd else parts[::2]
    return " ".join(kept)


def without_code(text: str) -> str:
    """``text`` without fenced and inline code and without code elements; one pass per kind of mark."""
    text = _without_pairs(_without_pairs(text, "```"), "~~~")
    if "`" in text:
        text = _INLINE.sub(" ", text)
    for name in ("code", "pre"):
        opening, closing = re.compile(rf"<{name}\b", re.I), re.compile(rf"</{name}>", re.I)
        kept, at = [], 0
        while (start := opening.search(text, at)) and (end := closing.search(text, start.end())):
            kept.append(text[at : start.start()])
            at = end.end()
        text = " ".join([*kept, text[at:]])
    return text


_BREAKS_BEFORE = re.compile(r"\. |\n|! |\? ")
_BREAKS_AFTER = re.compile(r"\. |\n")


def has_open_field(text: str) -> bool:
    """Whether a field of a form or template was left unfilled; ``text`` in even spelling."""
    names = {name for sign, those in SIGNS.items() if sign in text for name in those}
    lower = text.lower()
    if any(sign in lower for sign in DATE_SIGNS):
        names.add("date mask")
    if not names:
        return False
    if "`" in text or "~~~" in text or "<" in text:
        text = without_code(text)
    fields = [match.span() for name in names for match in _FIELD[name].finditer(text)]
    if not fields:
        return False
    mentions = [match.span() for match in _TUTORIAL.finditer(text)]
    if not mentions:
        return True
    # the sentence of each field, by bisection in what is found once: linear in the text however many fields it has
    starts, ends = [m[0] for m in mentions], [m[1] for m in mentions]
    before = [m.end() for m in _BREAKS_BEFORE.finditer(text)]
    after = [m.start() for m in _BREAKS_AFTER.finditer(text)]
    doubtful = 0
    for start, end in fields:
        k = bisect_right(before, start) - 1
        low = before[k] if k >= 0 else 0
        k = bisect_left(after, end)
        high = after[k] if k < len(after) else len(text)
        told_before = bisect_right(ends, start) > bisect_left(starts, low)
        told_after = bisect_right(ends, high) > bisect_left(starts, end)
        if not told_before and not told_after:
            return True
        doubtful += 1
    # a text that explains fields has a few among many words; a form has them densely
    return doubtful >= 4 and doubtful * 12 > len(_WORD.findall(text))


def _unit_kind(unit: str) -> str:
    """'bad', 'furniture' or 'content' for one line or sentence in lower case."""
    unit = unit.strip(" \t\"'“”*#>-•").rstrip(".!:;, ")
    if not unit or _FURNITURE.fullmatch(unit):
        return "furniture"
    if _ERROR.fullmatch(unit) or _SCRIPT.fullmatch(unit) or _FILLER.fullmatch(unit):
        return "bad"
    if _NUMBERED.fullmatch(unit):
        return "furniture"
    words = _WORD.findall(unit)
    least = 1.0 if _SENTENCE.search(unit) else 0.8  # of several sentences one may be real
    if words and sum(w in LATIN for w in words) >= least * len(words) and (len(words) > 2 or "lorem" in words):
        return "bad"
    return "content"


def only_residue(text: str) -> bool:
    """Whether a text is nothing but filler, errors or script notices, page furniture aside; in even spelling."""
    bad = False
    for line in _UNIT.finditer(text):
        whole = line[0].strip().lower()
        if not whole:
            continue
        kind = _unit_kind(whole)
        if kind == "content":
            for sentence in _SENTENCE.split(whole):
                kind = _unit_kind(sentence)
                if kind == "content":
                    return False
                bad |= kind == "bad"
        bad |= kind == "bad"
    return bad


def is_residue(text: str) -> bool:
    text = _even(text)
    return has_open_field(text) or only_residue(text)


def marked(documents: DataFrame, column: str = "text", out: str = "residue") -> DataFrame:
    """``documents`` with the boolean ``out``: unfilled fields, or nothing but residue. Whole texts, one pass, no shuffle.

    Null and blank texts are no residue (false). Rows and all other columns are kept; a column named ``out`` is replaced.
    """
    base = documents.drop(out) if out in documents.columns else documents
    at = base.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = pa.array([text.is_valid and is_residue(text.as_py()) for text in batch.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, flags], [*batch.schema.names, out])

    from pyspark.sql.types import BooleanType, StructType

    return base.mapInArrow(run, StructType([*base.schema.fields, *StructType().add(out, BooleanType()).fields]))


def found(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents that are residue; null ids give no row."""
    return marked(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).where("residue").select("doc_id").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that aren't residue, those without text included."""
    return marked(documents).where(~F.col("residue")).drop("residue")
