"""Keyword tables and their evaluation.  Rules are data: pass other tables for other domains."""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrain.functions.text import trimmed


def header_key(field: Column) -> Column:
    return trimmed(F.lower(field))


def first_word(header: Column, words: Sequence[str]) -> Column:
    """The first listed word the header contains, else null."""
    if not words:
        return F.lit(None).cast("string")
    # one literal that the optimizer folds into an array
    listed = F.split(F.lit("\n".join(words)), "\n")
    return F.get(F.filter(listed, lambda w: F.contains(header, F.lower(w))), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out a single time per row.

    Later expressions that use them several times see plain columns: a generator is
    not merged into the projections above it.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


@dataclass(frozen=True)
class FieldRule:
    """One line of a rule table: what is said of a column for which all its conditions hold.

    ``kind`` asks for a typed column of that kind, ``words`` for one of these words in the header (``pattern`` for a match
    instead), ``bounds`` for measures: ``(name, ">" or "<", limit)``.  Of the rules that hold, the least ``priority`` decides, wherever
    it stands in the table.  In ``reasons`` a measure's name in braces is its share in percent, ``{word}`` the word that was found, and
    ``{field}`` the header.
    """

    priority: int
    answer: tuple[str, ...]
    reasons: tuple[str, ...] = ()
    kind: str | None = None
    words: tuple[str, ...] = ()
    pattern: str | None = None
    bounds: tuple[tuple[str, str, float], ...] = ()

    def holds(self, header: Column, word_boundary: bool = False) -> tuple[Column, Column]:
        """Whether the rule holds, and the word that was found (null without words)."""
        test, word = F.lit(True), F.lit(None).cast("string")
        if self.kind is not None:
            test = test & (F.col("kind") == self.kind)
        if self.words or self.pattern:
            word = first_word(header, self.words)
            if word_boundary and self.words:
                # Latin words must stand alone between separators; other scripts stay substrings
                latin = [w for w in self.words if w.isascii()]
                alone = header.rlike("(^|[^a-z0-9])(" + "|".join(latin) + ")($|[^a-z0-9])") if latin else F.lit(False)
                other = first_word(header, [w for w in self.words if not w.isascii()])
                word = F.when(alone | other.isNotNull(), word)
            named = word.isNotNull()
            test = test & (named | header.rlike(self.pattern) if self.pattern else named)
        for measure, sign, limit in self.bounds:
            test = test & (F.col(measure) > limit if sign == ">" else F.col(measure) < limit)
        return F.coalesce(test, F.lit(False)), word

    def texts(self, word: Column) -> Column:
        return F.array(*(_filled(r, word) for r in self.reasons)).cast("array<string>")


def _filled(reason: str, word: Column) -> Column:
    """A reason with shares and the found word put in."""
    parts = re.split(r"\{(\w+)\}", reason)
    if len(parts) == 1:
        return F.lit(reason)
    return F.concat(*(
        F.lit(part) if i % 2 == 0 else word if part == "word" else F.col("field") if part == "field" else F.format_string("%.0f%%", F.col(part) * 100.0)
        for i, part in enumerate(parts)
    ))


def decided(table: Sequence[FieldRule], names: Sequence[str], header: Column, bounded: Collection[int] = ()) -> Column:
    """What the rule of least priority says: a struct of ``names`` and ``reasons``; null where no rule holds.

    Rules with a priority in ``bounded`` take their Latin words at word boundaries only.
    """
    said = []
    for rule in table:
        holds, word = rule.holds(header, rule.priority in bounded)
        said.append(F.when(holds, F.struct(
            F.lit(rule.priority).alias("priority"),
            F.struct(*(F.lit(v).alias(n) for n, v in zip(names, rule.answer, strict=True)), rule.texts(word).alias("reasons")).alias("said"),
        )))
    return F.array_min(F.array(*said))["said"]


@dataclass(frozen=True)
class NameRule:
    """Headers with one of ``words`` get this type, role and direction."""

    words: tuple[str, ...]
    data_type: str
    role: str
    direction: str
    label: str = ""


# ---- fixed values: generic header words, tested in this order -----------------
IDENTIFIER_WORDS = (
    "id", "编号", "代码", "编码", "账号", "工号", "订单号", "sku", "货号", "条码",
    "手机号", "电话", "身份证", "护照", "卡号",
)
TIME_WORDS = ("时间", "日期", "创建时间", "更新时间", "开始时间", "结束时间", "datetime", "timestamp")
CATEGORY_WORDS = (
    "类型", "类别", "分类", "状态", "级别", "等级", "部门", "地区",
    "省份", "城市", "性别", "民族", "门店", "店铺", "仓库", "渠道", "站点",
)
DESCRIPTION_WORDS = ("说明", "备注", "描述", "摘要", "内容", "详情", "地址")
BOOLEAN_WORDS = ("是否", "已", "未", "有效", "启用", "禁用")
# time/date at the start of a header or after a separator, or at its end after one
RE_TIME_HEADER = r"(^|[_\-\s/])(time|date)|[_\-\s](time|date)$"

_NAMED = ('字段名包含"{word}"',)
_MANY, _SOME = "数值比例高({numeric_ratio})", "数值比例中等({numeric_ratio})"
IDENTIFIER_NAMES = 20
# data type, role, direction, source, confidence
GENERIC_RULES = (
    FieldRule(10, ("datetime", "time", "neutral", "structure", "high"), ("typed column",), kind="time"),
    FieldRule(11, ("boolean", "dimension", "neutral", "structure", "high"), ("typed column",), kind="flag"),
    FieldRule(IDENTIFIER_NAMES, ("identifier", "identifier", "neutral", "name_rule", "high"), _NAMED, words=IDENTIFIER_WORDS),
    FieldRule(21, ("datetime", "time", "neutral", "name_rule", "high"), ("字段名符合时间特征",), words=TIME_WORDS, pattern=RE_TIME_HEADER),
    FieldRule(22, ("category", "dimension", "neutral", "name_rule", "high"), _NAMED, words=CATEGORY_WORDS),
    FieldRule(23, ("text", "description", "neutral", "name_rule", "high"), _NAMED, words=DESCRIPTION_WORDS),
    FieldRule(24, ("boolean", "dimension", "neutral", "name_rule", "high"), _NAMED, words=BOOLEAN_WORDS),
    FieldRule(30, ("identifier", "identifier", "neutral", "structure", "high"), (_MANY, "唯一率高且多为长数字串"),
              bounds=(("numeric_ratio", ">", 0.8), ("unique_ratio", ">", 0.9), ("long_digit_ratio", ">", 0.5))),
    FieldRule(31, ("number", "metric", "unspecified", "structure", "medium"), (_MANY, "内容为连续小整数（可能是序号/优先级/编号，非业务结论）"),
              bounds=(("numeric_ratio", ">", 0.8), ("integer_ratio", ">", 0.9), ("small_integer_ratio", ">", 0.7), ("unique_ratio", ">", 0.5))),
    FieldRule(32, ("number", "metric", "unspecified", "structure", "high"), (_MANY, "大部分为数值"), bounds=(("numeric_ratio", ">", 0.8),)),
    FieldRule(33, ("category", "dimension", "neutral", "structure", "medium"), (_SOME, "唯一率低，可能是类别"),
              bounds=(("numeric_ratio", ">", 0.5), ("unique_ratio", "<", 0.2))),
    FieldRule(34, ("number", "metric", "unspecified", "structure", "medium"), (_SOME,), bounds=(("numeric_ratio", ">", 0.5),)),
    FieldRule(35, ("text", "description", "neutral", "structure", "medium"), ("唯一率高且平均字符串长度长",),
              bounds=(("numeric_ratio", "<", 0.3), ("unique_ratio", ">", 0.8), ("avg_length", ">", 10))),
    FieldRule(36, ("category", "dimension", "neutral", "structure", "medium"), ("唯一率低",), bounds=(("numeric_ratio", "<", 0.3), ("unique_ratio", "<", 0.3))),
    FieldRule(37, ("text", "description", "neutral", "structure", "low"), ("大部分为文本",), bounds=(("numeric_ratio", "<", 0.3),)),
    FieldRule(99, ("unknown", "unspecified", "unspecified", "structure", "unknown"), ("无法通过内容特征确定类型",)),
)

# ---- fixed values: education words -------------------------------------------
EDU_SCORE_WORDS = (
    "总分", "语文", "数学", "英语", "外语", "物理", "化学", "生物",
    "政治", "历史", "地理", "成绩", "分数", "得分",
    "总分（不含加分）", "原始总分", "标准总分",
    "综合", "文科综合", "理科综合",
    "高考成绩", "综合成绩", "赋分后成绩", "赋分前成绩", "语数英总",
    "等级分", "标准分", "原始分", "转换分",
)
EDU_SUBJECT_WORDS = (
    "体育", "音乐", "美术", "信息技术", "通用技术",
    "心理健康", "劳动技术", "研究性学习", "社会实践",
)
EDU_RANK_WORDS = (
    "名次", "排名", "位次", "年级名次", "班级名次",
    "校排", "班排", "年排", "级排",
)
EDU_BONUS_WORDS = ("加分", "区内加分", "区外加分", "政策加分", "优惠加分", "特长加分", "奖励分", "奖励")
EDU_PENALTY_WORDS = ("扣分", "违纪扣分", "惩罚")
EDU_IDENTITY_WORDS = (
    "学校代码", "学校名称", "姓名", "班级", "考号", "座号", "学号",
    "考生号", "准考证", "考生姓名", "身份证号", "性别", "民族",
    "院系", "专业", "行政班", "教学班",
)
EDU_CATEGORY_WORDS = (
    "组合", "组合简称", "科类", "选科", "类别", "文理", "科类名称",
    "选考", "首选", "再选",
)
EDU_GROUPING_WORDS = ("班级", "学校", "学校名称", "院系", "专业", "行政班", "教学班", "性别", "民族")

EDUCATION_TEMPLATE = (
    NameRule(EDU_RANK_WORDS, "number", "metric", "lower_is_better", "排名指标"),
    NameRule(EDU_SCORE_WORDS, "number", "metric", "higher_is_better", "成绩指标"),
    NameRule(EDU_BONUS_WORDS, "number", "metric", "higher_is_better", "加分指标"),
    NameRule(EDU_PENALTY_WORDS, "number", "metric", "lower_is_better", "扣分指标"),
    NameRule(EDU_IDENTITY_WORDS, "identifier", "identifier", "neutral", "身份标识"),
    NameRule(EDU_CATEGORY_WORDS, "category", "dimension", "neutral", "分组维度"),
)

# ---- fixed values: older field metadata ---------------------------------------
PRIMARY_TOTAL_WORDS = (
    "总分", "总成绩", "综合成绩", "总评", "最终成绩",
    "高考成绩", "赋分后成绩", "赋分前成绩", "语数英总",
    "等级分", "标准分",
)
SECTION_TOTAL_WORDS = ("合计", "总计", "小计", "模块合计", "模块总分", "类别总分")
IDENTITY_DIMENSION_WORDS = (
    "班级", "学校", "院系", "专业", "行政班", "教学班",
    "性别", "民族", "科类", "组合", "选科",
)

# type, confidence
LEGACY_RULES = (
    FieldRule(1, ("unknown", 0.9), ('字段名"{field}"疑似数据行误识别为表头',), bounds=(("bad_header", ">", 0),)),
    FieldRule(10, ("rank", 0.9), _NAMED, words=EDU_RANK_WORDS),
    FieldRule(11, ("identity", 0.9), _NAMED, words=EDU_IDENTITY_WORDS),
    FieldRule(12, ("score", 0.9), _NAMED, words=EDU_SCORE_WORDS + EDU_SUBJECT_WORDS),
    FieldRule(13, ("category", 0.9), _NAMED, words=EDU_CATEGORY_WORDS),
    FieldRule(14, ("bonus", 0.9), _NAMED, words=EDU_BONUS_WORDS),
    FieldRule(15, ("penalty", 0.9), _NAMED, words=EDU_PENALTY_WORDS),
    FieldRule(20, ("identity", 0.8), ("内容为长数字串且唯一率高({unique_ratio})，疑似标识/编码字段",),
              bounds=(("numeric_ratio", ">", 0.5), ("long_number", ">", 0), ("unique_ratio", ">", 0.8))),
    FieldRule(21, ("category", 0.7), ("取值重复度高({unique_ratio})，疑似类别/分组字段",), bounds=(("numeric_ratio", ">", 0.5), ("class_label", ">", 0))),
    FieldRule(22, ("category", 0.7), ("取值重复度高({unique_ratio})，疑似类别/分组字段",), bounds=(("numeric_ratio", ">", 0.5), ("unique_ratio", "<", 0.2))),
    FieldRule(23, ("unknown", 0.5), ("数值比例高({numeric_ratio})，业务角色由通用 schema 推断",), bounds=(("numeric_ratio", ">", 0.5),)),
    FieldRule(24, ("category", 0.7), ("文本取值重复度高({unique_ratio})，疑似类别/分组字段",),
              bounds=(("total", ">", 0), ("text_ratio", ">", 0.6), ("unique_ratio", "<", 0.2))),
    FieldRule(25, ("text", 0.7), ("大部分内容为文本({text_ratio})",), bounds=(("total", ">", 0), ("text_ratio", ">", 0.6))),
    FieldRule(99, ("unknown", 0.3), ("无法通过关键词或内容特征确定类型",)),
)
