"""Questions, answers and cases as yes-or-no column expressions.

Lexicons match substrings of the lower-cased text, inside words too; ``any`` alone is a whole word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.mcq import events, options
from ..functions.text import contains_any

# fixed values: substring lexicons
NEGATIVE = ("no ", "not ", "none", "absent", "doesn't", "didn't", "cannot see", "can't see", "没有", "不存在", "未看到", "看不到", "没看到", "无法看到")
NEGATIVE_SCOPE = ("checked", "available", "provided", "retrieved", "evidence", "frames", "已检查", "当前", "现有", "提供", "检索", "证据", "关键帧")
NEGATIVE_QUESTION = ("no ", "without", "有没有", "是否有", "没有", "不存在")
VISUAL_CLAIMS = (
    "shows", "shown", "visible", "appears", "looks", "wearing", "holding", "standing", "walking", "running", "moving", "object", "person", "scene", "frame",
    "看到", "画面", "显示", "出现", "人物", "人", "物体", "颜色", "穿", "拿", "站", "走", "跑", "移动", "动作", "镜头",
)
RANKING = ("top 1", "top 2", "top 3", "rank", "ranking", "listed", "order", "sequence", "correct order", "first", "second", "third", "第", "排名", "顺序")
SLIDE_WORDS = ("ocr", "slide", "screen", "text", "shown", "featured", "company", "logo", "list", "listed", "top", "rank", "ranking", "PPT", "画面文字", "屏幕", "公司", "标志", "榜单", "排名")
BRAND_SCREEN = ("brand", "logo", "shoe cleaner", "recommended", "品牌", "推荐", "标志")
GUESSES = ("widely recognized", "typical", "characteristic", "least implausible", "most consistent", "commonly associated", "standard product", "likely", "probably", "猜测", "可能")
BRAND_GUESSES = ("widely recognized", "typical", "characteristic", "least implausible", "standard product")
AUDIOVISUAL = (
    "featured in the video but not mentioned in the audio", "shown in the video but not mentioned", "visible but not mentioned", "shown but not said", "mentioned but not visible",
    "not mentioned in the audio", "not mentioned in audio", "audio", "visual", "画面", "音频", "旁白", "提到", "没有提到",
)
HEARD, SEEN = ("audio", "transcript", "mentioned", "提到"), ("video", "visual", "shown", "featured", "visible", "画面")
UNCERTAINTY = (
    "not enough", "insufficient", "cannot determine", "can't determine", "unclear", "not visible", "checked frames", "checked evidence", "do not see", "don't see",
    "无法确定", "不能确定", "不确定", "证据不足", "看不清", "未能确认",
)
TEMPORAL_CASE = ("sequence", "order", "top 2", "rank", "listed", "temporal")


def is_negative_question(q: Column, kind: Column) -> Column:
    t = F.lower(F.trim(q))
    return (kind == "existence") | t.rlike(r"^(is|are|was|were) there ") | t.rlike(r"(?U)\bany\b") | contains_any(t, NEGATIVE_QUESTION)


def is_ranking_question(q: Column) -> Column:
    return contains_any(q, RANKING)


def has_temporal_candidates(q: Column) -> Column:
    return (F.size(events(q)) > 0) | (is_ranking_question(q) & (F.size(options(q)) > 0))


def needs_slide(q: Column, kind: Column) -> Column:
    return (F.lower(kind) == "text_ocr") | contains_any(q, SLIDE_WORDS)


def is_brand_question(q: Column) -> Column:
    return contains_any(q, BRAND_SCREEN)


def is_audiovisual_question(q: Column) -> Column:
    return contains_any(q, AUDIOVISUAL) & contains_any(q, HEARD) & contains_any(q, SEEN)


def guesses(answer: Column) -> Column:
    return contains_any(answer, GUESSES)


def says_no(answer: Column) -> Column:
    return contains_any(answer, NEGATIVE)


def has_scope(answer: Column) -> Column:
    return contains_any(answer, NEGATIVE_SCOPE)


def is_uncertain(answer: Column) -> Column:
    return contains_any(answer, UNCERTAINTY)


def claim_lines(answer: Column) -> Column:
    """Sentences that claim something visible; a full stop inside a marker splits as well."""
    parts = F.transform(F.split(answer, "[\n。！？.!?]+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & contains_any(p, VISUAL_CLAIMS))


def is_temporal_case(question: Column, kind: Column) -> Column:
    return contains_any(F.concat_ws(" ", question, kind), TEMPORAL_CASE)


def is_comparison_case(question: Column) -> Column:
    return contains_any(question, ("audio", "mentioned")) & contains_any(question, ("video", "visual", "featured", "shown"))


def is_brand_guess(question: Column, answer: Column) -> Column:
    return is_brand_question(question) & contains_any(answer, BRAND_GUESSES)
