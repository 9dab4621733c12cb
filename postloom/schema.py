"""Data model: columns, layer schemas, statistic types and fixed lookup values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# Snapshot file column -> name used in this library, in file order.
SNAPSHOT_COLUMNS = {
    "yuan_shi_gangwei_bianhao": "raw_id",
    "yunxing_biaoshi": "run_id",
    "guanjianci": "keyword",
    "guanjianci_daima": "scope_code",
    "guanjianci_biaoshi": "scope_id",
    "chengshi_liebiao": "city_list",
    "chengshi_daima_liebiao": "city_code_list",
    "laiyuan_chengshi": "city",
    "gangwei_weiyi_biaoshi": "job_uid",
    "zhiwei_mingcheng": "job_name",
    "zuidi_xinzi": "salary_low",
    "zuigao_xinzi": "salary_high",
    "gongzuo_didian": "address",
    "jingyan_yaoqiu": "experience",
    "xueli_yaoqiu": "education",
    "gongzuo_leixing": "job_type",
    "gongzuo_moshi": "work_mode",
    "zhiwei_leibie": "category",
    "gongsi_mingcheng": "company",
    "gongsi_guimo": "company_size",
    "gongsi_xingzhi": "company_type",
    "rongzi_jieduan": "financing",
    "hangye": "industry",
    "fabu_shijian": "publish_time",
    "zhaopin_fuzeren_zhuangtai": "recruiter_status",
    "zhaopin_fuzeren_huoyue_biaoqian": "recruiter_activity",
    "jineng_biaoqian": "skills",
    "zhiwei_miaoshu": "description",
}

AMOUNT = "decimal(10,2)"

# Text columns that change name and type in the detail layer.
TYPED_COLUMNS = {
    "raw_id": ("raw_id", T.LongType()),
    "salary_low": ("salary_low_wan", T.DecimalType(10, 2)),
    "salary_high": ("salary_high_wan", T.DecimalType(10, 2)),
    "publish_time": ("publish_date", T.DateType()),
}

# Columns that a skill row takes from its posting.
SKILL_PARENT_COLUMNS = [
    "raw_id",
    "run_id",
    "job_uid",
    "keyword",
    "scope_code",
    "scope_id",
    "city_list",
    "city",
    "job_name",
    "company",
]


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _detail() -> T.StructType:
    fields = []
    for name in SNAPSHOT_COLUMNS.values():
        new_name, data_type = TYPED_COLUMNS.get(name, (name, T.StringType()))
        fields.append(T.StructField(new_name, data_type))
    return T.StructType(fields)


SNAPSHOT = _strings(SNAPSHOT_COLUMNS.values())
DETAIL = _detail()
SKILL = T.StructType(
    [DETAIL[name] for name in SKILL_PARENT_COLUMNS]
    + [T.StructField("skill", T.StringType()), T.StructField("skill_pos", T.IntegerType())]
)
SERVING = T.StructType(
    SNAPSHOT.fields
    + [
        T.StructField("created_at", T.TimestampType()),
        # What listings are ordered by, typed, so that bounds on it reach the scan.
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("raw_number", T.LongType()),
    ]
)
#: Counts behind the statistics that can be added and taken away.
STATISTIC_COUNT = T.StructType(
    [
        T.StructField("stat_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("total", T.DecimalType(28, 2)),
        T.StructField("jobs", T.LongType()),
        T.StructField("known_rows", T.LongType()),
        T.StructField("scope_id", T.StringType()),
    ]
)
#: Entity tables made from the cleaned postings.
CLEAN_COMPANY = _strings(["raw_id", "company", "company_size", "company_type", "financing", "industry", "scope_id"])
CLEAN_RECRUITER = _strings(["raw_id", "job_uid", "recruiter_status", "recruiter_activity", "scope_id"])
#: Postings in the layout of keyword search, and the search index: places of a bigram within a block of numbers.
POSTING_SEARCH = T.StructType([*SERVING.fields, T.StructField("doc", T.LongType())])
KEYWORD_INDEX = T.StructType(
    [
        T.StructField("gram", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
        T.StructField("scope_id", T.StringType()),
    ]
)
STATISTIC = T.StructType(
    [
        T.StructField("scope_id", T.StringType()),
        T.StructField("stat_type", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("payload", T.StringType()),
    ]
)
RUN_LOG = T.StructType(
    [
        T.StructField("scope_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_out", T.LongType()),
        T.StructField("logged_at", T.StringType()),
    ]
)

# Statistic types in serving order.
STAT_TYPES = [
    "summary",
    "city",
    "salary",
    "education",
    "experience",
    "company_size",
    "company_type",
    "financing",
    "top_companies",
    "industry",
    "publish_trend",
    "skills",
]

# Statistic type -> posting column it counts.
CATEGORY_COLUMN = {
    "city": "city",
    "education": "education",
    "experience": "experience",
    "company_size": "company_size",
    "company_type": "company_type",
    "financing": "financing",
    "top_companies": "company",
    "industry": "industry",
}
TOP_LIMIT = {"top_companies": 15, "industry": 15, "skills": 20}
# Statistics of the company view.
COMPANY_TYPES = ["company_size", "company_type", "financing", "top_companies"]

# Dashboard view -> statistic types it shows.
DASHBOARD_VIEWS = {
    "all": STAT_TYPES,
    "summary": ["summary"],
    "city": ["city"],
    "salary": ["salary"],
    "education": ["education"],
    "experience": ["experience"],
    "industry": ["industry"],
    "skills": ["skills"],
    "company": COMPANY_TYPES,
}
TREND_DAYS = 30

UNKNOWN = "未知"
OTHER = "其他"

# Upper bound (exclusive) of average annual salary in 万 -> label.
SALARY_BUCKETS = [
    (5, "0-5"),
    (10, "5-10"),
    (15, "10-15"),
    (20, "15-20"),
    (30, "20-30"),
    (50, "30-50"),
    (None, "50+"),
]

# Label shown in place of a blank field, in job listings and in job details.
LIST_LABELS = {"education": "不限", "experience": "不限", "company_type": "未知"}
# What stands for an empty skill list, and for a figure that is absent.
NO_SKILLS, ABSENT = "暂无技能标签", "—"
DETAIL_LABELS = {
    "education": "学历不限",
    "experience": "经验不限",
    "job_type": "全职",
    "financing": "融资信息未知",
    "description": "暂无职位描述",
    "industry": "未知",
    "publish_time": "未知",
    "recruiter_status": "未知",
}

# Facet name -> posting column.
FACETS = {
    "cities": "city",
    "educations": "education",
    "experiences": "experience",
    "company_sizes": "company_size",
    "industries": "industry",
}
EQUALITY_FACETS = ["city", "education", "experience", "company_size", "industry"]
SEARCH_COLUMNS = ["job_name", "company", "skills", "description"]

# Posting column -> field name in a job listing.
LIST_FIELDS = {
    "job_uid": "job_id",
    "job_name": "job_name",
    "city": "city",
    "salary_low": "salary_min",
    "salary_high": "salary_max",
    "education": "education",
    "experience": "experience",
    "company": "company_name",
    "company_size": "company_size",
    "company_type": "company_type",
    "industry": "industry",
    "publish_time": "publish_time",
}

# Posting column -> field name in a job detail.
DETAIL_FIELDS = {
    "job_uid": "job_id",
    "job_name": "job_name",
    "city": "city",
    "address": "address",
    "salary_low": "salary_min",
    "salary_high": "salary_max",
    "education": "education",
    "experience": "experience",
    "job_type": "job_type",
    "work_mode": "work_mode",
    "category": "category",
    "company": "company_name",
    "company_size": "company_size",
    "company_type": "company_type",
    "financing": "financing",
    "industry": "industry",
    "publish_time": "publish_time",
    "recruiter_status": "recruiter_status",
    "recruiter_activity": "recruiter_activity",
    "skills": "skills",
    "description": "description",
}

# Bounds of pages and contexts, and what marks a cut text.
MAX_PAGE = 1_000_000
MAX_PAGE_SIZE = 50
DEFAULT_PAGE_SIZE = 10
CONTEXT_LIMIT = 24_000
TRUNCATED = "...(已截断)"
CONTEXT_TRUNCATED = "\n...(输入数据已截断，只保留主要统计字段)"

# City -> (longitude, latitude).
CITY_COORDINATES = {
    "北京": (116.4, 39.9),
    "上海": (121.47, 31.23),
    "广州": (113.26, 23.13),
    "深圳": (114.06, 22.55),
    "天津": (117.2, 39.12),
    "武汉": (114.31, 30.59),
    "西安": (108.94, 34.34),
    "成都": (104.07, 30.67),
    "大连": (121.61, 38.91),
    "长春": (125.32, 43.82),
    "沈阳": (123.43, 41.8),
    "南京": (118.8, 32.06),
    "济南": (117.12, 36.65),
    "青岛": (120.38, 36.07),
    "杭州": (120.15, 30.27),
    "苏州": (120.59, 31.3),
    "无锡": (120.31, 31.49),
    "宁波": (121.55, 29.87),
    "重庆": (106.55, 29.56),
    "郑州": (113.63, 34.75),
    "长沙": (112.94, 28.23),
    "福州": (119.3, 26.08),
    "厦门": (118.09, 24.48),
    "哈尔滨": (126.64, 45.76),
}


@dataclass(frozen=True)
class Scope:
    """One search keyword; its code names the partition in every table."""

    keyword: str
    scope_id: str

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_]+", self.scope_id):
            raise ValueError(f"scope id must be a plain code, got {self.scope_id!r}")
