"""Figures in prose and tables: their values, what they measure, and the facts around them, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels of each role, a number, provinces, spoken negation, words that make a place a wish, words that make it part of a name.
LABELS = {
    "SCORE": "最低分|最高分|平均分|最低投档分|投档最低分|录取最低分|最低录取分|分数线|投档线|录取线|专业录取线|专业线|分数",
    "RANK": "最低位次|最高位次|录取位次|投档位次|位次|排名|排位",
    "GROUP": "专业组(?:代码|编号)?",
    "COUNT": "招生计划(?:数)?|计划招生(?:数)?|录取人数|计划数|计划招收|计划招",
}
_BEGINS = "".join(sorted({label[0] for labels in LABELS.values() for label in labels.split("|")}))  # most characters begin no label
ANY_LABEL = f"(?=[一-鿿])(?=[{_BEGINS}])(?:{'|'.join(LABELS.values())})"
#: Plain words, one of which stands in every text that holds a label of the role, and that hold one themselves.
WORDS = {
    "SCORE": ("最低分", "最高分", "平均分", "最低投档分", "最低录取分", "投档线", "录取线", "专业线", "分数"),
    "RANK": ("位次", "排名", "排位"),
    "GROUP": ("专业组",),
    "COUNT": ("招生计划", "计划招", "录取人数", "计划数"),
}
VALUE = r"\d[\d,，]*(?:\.\d+)?\s*[万千]?"
PROVINCES = "北京|天津|河北|山西|内蒙古|辽宁|吉林|黑龙江|上海|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|广西|海南|重庆|四川|贵州|云南|西藏|陕西|甘肃|青海|宁夏|新疆|香港|澳门|台湾"
NEGATED = "不是|不在|不选|不报|不属于|非"
WISHED = "想去|想读|偏好|喜欢|目标|倾向|考虑|报考|想在|去"
NAMED = "大学|学院|理工|师范|科技|交通|农业|医科|工业|财经|航空|外国语|邮电|电子"
#: What asks for advice on admission; what starts the conditions anew; what a follow-up mentions.
ASKS = (
    r"志愿(?!者|服务)|填报|报考|投档|录取线|分数线|招生计划|高考.{0,30}(?:志愿|院校|大学|学校)|"
    r"(?:多少|\d{3})分.{0,12}(?:大学|学校|能上|能去|去哪|上哪|读哪|报哪)|(?:能上|能报|能去|报哪些|上哪些|读哪些).{0,8}(?:大学|学校|院校|专业)"
)
STARTS_ANEW = "换个情况|换一个情况|另一个考生|新考生|重新来|重新开始|换个考生"
FOLLOWS_UP = r"20\d{2}|\d{3}\s*分|位次|排名|排位|物理|历史|选科|文科|理科|本科|专科|批次|那所|这所|该校|这几个|那几个|那.{0,20}呢[？?]?"
#: A condition's pattern, its value being the first group that matched.
SLOTS = {
    "province": f"({PROVINCES})",
    "year": r"(20\d{2})",
    "subjects": "(物理|历史|理科|文科|综合改革|不限科)",
    "score": r"(?:(\d{3})\s*分|(?:分数\s*[：:]?|考了|考分)\s*(\d{3}))",
    "rank": r"(?:位次|排名|排位|全省排).{0,5}?(\d[\d,，]*(?:\.\d+)?[万千]?)",
    "batch": "(本科|专科|普通批|提前批|本一|本二|一本|二本)",
}
#: Sentences that are checked, those that state a cut-off, those that say that it is not known, and questions about it.
CHECKED, CHECKED_POINTS = ("大学", "学院", "录取", "投档", "位次", "专业组", "招生", "分数线"), r"\d\s*分"
CUTOFF, CUTOFF_OF_SCHOOL = ("投档线", "录取线", "最低分", "专业线", "计划招", "招生计划"), "(?:大学|学院).{0,24}(?:投档|录取|最低|专业|分|位次)"
UNSURE = "不清楚|查不到|不能.{0,8}(?:判断|推荐|保证)|没有.{0,8}(?:资料|依据)|尚未.{0,8}公布"
ASKED = (
    r"(?:能否|能不能|是否|是不是).{0,12}(?:录取|达到|能上)|\d\s*分.{0,12}(?:能录取|能上|能报考)(?:吗|么)[？?]?\s*$|"
    r"(?:最低分|投档线|录取线|最低位次)(?:是|为)?\s*\d[\d,，]*(?:\.\d+)?\s*(?:分|名)?(?:吗|么)[？?]?\s*$"
)
#: Admissions of a gap, statements of news that are none, questions back.
GAP = (
    "无法.{0,10}(?:确认|核实|判断)|不能.{0,10}(?:确认|核实|判断|保证)|没有.{0,20}(?:依据|资料)|尚未.{0,10}核实|未核实|不确定|查不到|没查到|"
    "未查到|没找到|资料.{0,8}不足|依据.{0,8}不足|拿不准|没有核实|还没核实|未能核实|未核对"
)
NEWS = (
    r"(?:今天|最新|目前|现在|今年).{0,18}(?:公布|发布|出台|涨|跌|达到|是\d|为\d)|(?:政策|价格|股价|录取线|投档线|分数线|最低分|最低位次).{0,12}(?:已经|达到|为?\d)"
)
ASKS_BACK = (
    "哪个(?:省|城市|国家|地区|公司|学校|专业|政策)|哪(?:一年|年|种|一天)|你指的是|请.{0,12}补充|先.{0,12}告诉|需要.{0,12}(?:提供|信息)|"
    "能.{0,12}(?:补充|说说)|把.{0,16}(?:选科|位次|年份).{0,12}(?:说|给)"
)
#: What asks for present facts.
DYNAMIC = "查一下|查查|查一查|搜一下|搜一搜|查资料|联网|最新|实时|现价|股价|票价|天气|(?:今年|当年|现在|目前).{0,18}(?:政策|分数线|录取|价格|名单|任职|版本|行情|招生|数据)"
#: A school's name, what goes before one in a source, what points back to one, what history may be called.
SCHOOL_NAME = r"[一-鿿A-Za-z·]{2,24}(?:大学|学院)"
BEFORE_SCHOOL = r"(?:^|[\n\s|；;，,。：:])"
POINTS_BACK = "(?:这所|那所|该|这个|那个)(?:大学|学院)$"
HISTORY = ("往年", "去年", "历史", "参考")
LONGEST_SCHOOL = 26

_ROLE = "array<struct<value:decimal(28,8),role:string>>"


def says(text: Column, *words: str) -> Column:
    """Whether a text holds one of some plain words."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def named_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def plain(text: Column) -> Column:
    """Whether a text is ASCII but for the ends of schools' names: then it holds no label, unit, province, branch or full stop, and no pattern need be looked for."""
    rest = F.replace(F.replace(text, F.lit("大学"), F.lit("")), F.lit("学院"), F.lit(""))
    return F.octet_length(rest) == F.length(rest)


def decimal_of(raw: Column) -> Column:
    """The value of one number as written, with thousands separators and multipliers; null if it is none."""
    written = says(raw, ",", "，", ".", "万", "千") | (F.length(raw) > 18)
    times = F.when(raw.rlike(r"万\s*$"), 10000).when(raw.rlike(r"千\s*$"), 1000).otherwise(1)
    return F.when(~written, raw.try_cast("bigint").cast("decimal(28,8)")).otherwise((F.regexp_replace(raw, r"[,，\s万千]", "").try_cast("decimal(28,8)") * times).cast("decimal(28,8)"))


def values(text: Column) -> Column:
    """Distinct numbers of a text."""
    found = F.regexp_extract_all(text, F.lit(rf"(?=\d)(?<![\d.])({VALUE})"), 1)
    return F.array_distinct(F.filter(F.transform(found, decimal_of), lambda x: x.isNotNull()))


def written(value: Column) -> Column:
    """A value as the shortest text: equal values, equal texts."""
    return F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit("."))


def roles_named(text: Column) -> Column:
    """Which roles a text names, in order of LABELS."""
    return F.array_compact(F.array(*[F.when(says(text, *words), role) for role, words in WORDS.items()]))


def _after(text: Column, role: str, labels: str) -> Column:
    """The numbers that stand after one of a role's labels, with no other label between."""
    whole = rf"(?:{labels})([^\d\n|；;。]{{0,8}}?)({VALUE})"
    matches = F.regexp_extract_all(text, F.lit(rf"(?=[一-鿿]){whole}"), 0)
    heads = [head + tail for label in labels.split("|") for head, _, tails in [label.partition("(?:")] for tail in (["", *tails.rstrip(")?").split("|")] if "(?:" in label else [""])]

    def read(m: Column, raw: Column) -> Column:
        lead = F.left(m, F.length(m) - F.length(raw))
        between = F.when(lead.isin(heads), False).otherwise(F.regexp_extract(m, whole, 1).rlike(ANY_LABEL))
        return F.when(~between, F.struct(decimal_of(raw).alias("value"), F.lit(role).alias("role")))

    number = lambda m: F.regexp_replace(m, r"^\D+", "")  # noqa: E731  # neither labels nor what is between hold digits
    found = F.transform(matches, lambda m: named_once(number(m), lambda raw: read(m, raw)))
    return F.when(~says(text, *WORDS[role]), F.array().cast(_ROLE)).otherwise(F.filter(found, lambda x: x.isNotNull()))


def labelled(text: Column) -> Column:
    """(value, role) of the numbers that follow a label at once, or that are followed by the unit of scores."""
    found = [_after(text, role, labels) for role, labels in LABELS.items()]
    points = F.transform(F.regexp_extract_all(text, F.lit(rf"({VALUE})\s*分(?!钟|之)"), 1), lambda x: F.struct(decimal_of(x).alias("value"), F.lit("SCORE").alias("role")))
    unit = F.contains(F.replace(text, F.lit("最低分"), F.lit("")), F.lit("分"))  # a unit stands behind a number
    found.append(F.when(~unit, F.array().cast(_ROLE)).otherwise(points))
    return F.array_distinct(F.concat(*found))


def cells(line: Column) -> Column:
    """The trimmed cells of a table's line."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^[\s|]+|[\s|]+$", ""), r"\s*\|\s*", "|")
    return F.split(F.when(line.rlike(r"\s|^\||\|$"), inner).otherwise(line), r"\|")


#: A line of a pipe table whose cells are whole numbers as written() has them, or hold no digit: its cells are its numbers.
ROW = r"^(?:0|[1-9]\d{0,17}|[^\d\s|]++)(?:\|(?:0|[1-9]\d{0,17}|[^\d\s|]++))+$"


def celled(line: Column, header: Column) -> Column:
    """(value, role) of the cells below a heading that names one role, if the line has as many cells as the header (a role or null per cell)."""
    numbers = lambda cell: F.when(cell.rlike(r"^\d{1,18}$"), F.array(cell.try_cast("bigint").cast("decimal(28,8)"))).otherwise(values(cell))

    def below(row: Column) -> Column:
        one = F.filter(F.arrays_zip(row.alias("cell"), header.alias("role")), lambda x: x["role"].isNotNull())
        each = F.flatten(F.transform(one, lambda x: F.transform(numbers(x["cell"]), lambda v: F.struct(v.alias("value"), x["role"].alias("role")))))
        return F.when(F.size(row) == F.size(header), each)

    return F.coalesce(named_once(cells(line), below), F.array().cast(_ROLE))


def lines_below(text: Column) -> Column:
    """(at, line, header) of a text's lines, with the header of the pipe table that a line stands in: of each cell of the last heading above the one role that it names, or null. A heading
    names a role and holds no number; a line without a pipe ends a table.

    Lines that tell of headings begin blocks, and a block's lines take what its first one tells: the work grows with the lines.
    """
    one = lambda cell: named_once(roles_named(cell), lambda r: F.when(F.size(r) == 1, r[0]))
    heading = lambda x: F.when(~plain(x) & says(x, "分", "线", "位", "排名", "组", "划", "录取人数") & x.rlike(ANY_LABEL), F.when(F.size(values(x)) == 0, F.transform(cells(x), one)))

    def told(x: Column, at: Column) -> Column:
        piped = F.contains(x, F.lit("|"))
        return F.struct(at.alias("at"), x.alias("line"), piped.alias("piped"), F.when(piped, heading(x)).alias("header"))

    def blocks(lines: Column) -> Column:
        begins = F.transform(F.filter(lines, lambda x: (x["at"] == 0) | ~x["piped"] | x["header"].isNotNull()), lambda x: x["at"])

        def block(begins: Column) -> Column:
            upto = lambda i: F.coalesce(F.get(begins, i + 1), F.size(lines))
            return F.flatten(F.transform(begins, lambda at, i: named_once(lines[at]["header"], lambda header: F.transform(F.slice(lines, at + 1, upto(i) - at), lambda x: F.struct(x["at"], x["line"], header.alias("header"))))))

        return named_once(begins, block)

    return named_once(F.transform(F.split(text, "\n"), told), blocks)


def parts_of(line: Column) -> Column:
    """A line, cut at full stops and semicolons."""
    return F.when(~says(line, "；", ";", "。"), F.array(line)).otherwise(F.split(line, "[；;。]"))


def mentions(text: Column, pattern: str) -> Column:
    """Distinct matches of a plain alternation."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def provinces(text: Column) -> Column:
    return mentions(text, PROVINCES)


def asserted_years(text: Column) -> Column:
    return F.when(~says(text, "20"), F.array().cast("array<string>")).otherwise(mentions(text, r"20\d{2}"))


def checked(sentence: Column) -> Column:
    """Whether figures of a sentence need a source."""
    return says(sentence, *CHECKED) | (says(sentence, "分") & sentence.rlike(CHECKED_POINTS))


def cut_off(sentence: Column) -> Column:
    """Whether a sentence states a cut-off."""
    return says(sentence, *CUTOFF) | (says(sentence, "大学", "学院") & sentence.rlike(CUTOFF_OF_SCHOOL))


def unsure(sentence: Column) -> Column:
    """Whether a sentence says that a cut-off is not known, or asks for it."""
    return (says(sentence, "不清楚", "查不到", "不能", "没有", "尚未") & sentence.rlike(UNSURE)) | (says(sentence, "能否", "能不能", "是否", "是不是", "吗", "么") & asks_fact(sentence))


def supplied(text: Column, slot: str) -> Column:
    """(value, negated) of a condition's mentions, in order. A place that is wished for, or is part of a name, says nothing."""
    pattern = SLOTS[slot]
    wished = f"(?:{WISHED})(?:的)?" if slot == "province" else "(?!)"
    whole = rf"((?:{wished})\s*)?((?:{NEGATED})\s*)?{pattern}" + (f"({NAMED})?" if slot == "province" else "")
    groups = {"score": 2}.get(slot, 1)
    raw = F.regexp_extract_all(text, F.lit(whole), 0)

    def read(m: Column) -> Column:
        value = F.coalesce(*[F.nullif(F.regexp_extract(m, whole, 3 + k), F.lit("")) for k in range(groups)])
        named = (F.regexp_extract(m, whole, 3 + groups) != "") if slot == "province" else F.lit(False)
        return F.struct(value.alias("value"), (F.regexp_extract(m, whole, 2) != "").alias("negated"), (named | (F.regexp_extract(m, whole, 1) != "")).alias("idle"))

    return F.filter(F.transform(raw, read), lambda x: ~x["idle"])


def latest(found: Column) -> Column:
    """The value that stands at the end: each mention replaces the last, a negation takes back its own."""
    step = lambda now, x: F.when(~x["negated"], x["value"]).when(now == x["value"], F.lit(None)).otherwise(now)
    return F.aggregate(found, F.lit(None).cast("string"), step)


def slots(text: Column) -> Column:
    """The conditions of a text and the names of those that are missing; null if it does not ask for advice."""
    found = {s: latest(supplied(text, s)) for s in SLOTS}
    missing = F.array_compact(F.array(*[F.when(v.isNull(), s) for s, v in found.items()]))
    return F.when(text.rlike(ASKS), F.struct(*[v.alias(s) for s, v in found.items()], missing.alias("missing")))


def clarifies(text: Column) -> Column:
    """Whether a reply owns up to a gap or asks back; news that it states count against it, after the gap and before the question."""
    return F.when(text.rlike(GAP), True).when(text.rlike(NEWS), False).otherwise(text.rlike(ASKS_BACK))


def asks_fact(sentence: Column) -> Column:
    return sentence.rlike(ASKED)


def wants_present_facts(text: Column) -> Column:
    return text.rlike(DYNAMIC)
