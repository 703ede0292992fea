"""Labels, container codes, OCR text, stream names and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the detector's classes, by number.
LABELS = {0: "con_sello", 1: "sin_sello", 2: "cont data", 3: "container cod", 4: "truck"}
# Optics of a camera that has stored none.
DEFAULT_SPECS = {"h_fov_wide": 99.1, "h_fov_tele": 31.9, "v_fov_wide": 53.4, "v_fov_tele": 18.0, "pan_range": 355.0, "tilt_range": 90.0}
CODE = "([A-Z]{4}[0-9]{7})"


def with_label(df: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return df.withColumn("label", F.coalesce(F.try_element_at(table, F.col("class_id")), F.lit("unknown")))


def with_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def with_caption(df: DataFrame) -> DataFrame:
    """``label 0.87``, and the text in brackets if there is one."""
    text = F.col("ocr_text")
    return df.withColumn("caption", F.concat(F.format_string("%s %.2f", "label", "confidence"), F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.concat(F.lit(" ["), text, F.lit("]"))).otherwise("")))


def is_valid_code(code: Column) -> Column:
    """Container number with a right check digit: 4 letters, the last of them U, J or Z, and 7 digits."""
    c = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")

    def value(i: Column) -> Column:
        ch = F.substring(c, i, F.lit(1))
        k = F.ascii(ch) - 65
        letter = 10 + k + F.when(k >= 1, 1).otherwise(0) + F.when(k >= 11, 1).otherwise(0) + F.when(k >= 21, 1).otherwise(0)
        return F.when(k >= 0, letter).otherwise(F.ascii(ch) - 48)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda s, i: s + value(i) * F.pow(F.lit(2), i - 1).cast("int"))
    shape = F.rlike(c, F.lit("^[A-Z]{3}[UJZ][0-9]{7}$"))
    return F.coalesce(shape & (total % 11 % 10 == F.ascii(F.substring(c, 11, 1)) - 48), F.lit(False))


def extract_codes(text: Column) -> Column:
    """All candidates for a code in a text, from left to right, without overlap."""
    return F.regexp_extract_all(F.upper(text), F.lit(CODE), F.lit(1))


def ocr_full_text(regions: Column, least: float = 0.6) -> Column:
    """Joined text of (text, conf, bbox) regions: of those confident enough, the boxed ones from left to right
    if any has a box, else all as they come."""
    sure = F.filter(regions, lambda r: r.conf >= least)
    boxed = F.filter(sure, lambda r: F.size(r.bbox) > 0)
    x = lambda r: r.bbox[0][0]
    lined = F.array_sort(F.transform(boxed, lambda r, i: F.struct(x(r).alias("x"), i.alias("i"), r.text.alias("text"))))
    upper = lambda rs: F.array_join(F.transform(rs, lambda r: F.upper(r.text)), "")
    return F.when(F.size(boxed) > 0, upper(lined)).otherwise(upper(sure))


def ocr_lines(df: DataFrame, col: str = "raw", conf: float = 0.85) -> DataFrame:
    """Regions and best text of raw recognised text, a region a line that is not blank."""
    lines = F.filter(F.transform(F.split(F.col(col), "\n"), lambda t: F.trim(t)), lambda t: t != "")
    regions = F.transform(lines, lambda t: F.struct(t.alias("text"), F.lit(conf).alias("conf")))
    return df.withColumns({"regions": regions, "best": F.get(lines, F.lit(0))})


def ocr_best_region(df: DataFrame, least: float = 0.6) -> DataFrame:
    """The most confident region with a text, the first of equals, with its box as shares of the image."""
    ok = F.filter("regions", lambda r: (r.conf >= least) & (F.trim(r.text) != ""))
    first = F.element_at(ok, 1)
    best = F.when(F.size(ok) > 0, F.aggregate(ok, first, lambda a, r: F.when(r.conf > a.conf, r).otherwise(a)))
    out = df.withColumn("best", best)
    return out.withColumns({"best_text": F.trim("best.text"), "best_conf": F.col("best.conf"), "best_x": F.col("best.x") / F.col("width")}).drop("best")


def ocr_coalesce(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("ocr", F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns)))


def with_specs(df: DataFrame) -> DataFrame:
    """Camera optics, stored values over defaults."""
    return df.withColumns({k: F.coalesce(F.col(k) if k in df.columns else F.lit(None), F.lit(v)) for k, v in DEFAULT_SPECS.items()})


def stream_name(device: Column, token: Column, is_file: Column) -> Column:
    name = F.concat(F.lit("cam_"), device.cast("string"), F.lit("_"), token, F.when(is_file, "").otherwise("_hw"))
    return F.when(F.coalesce(F.length(token), F.lit(0)) > 0, name).otherwise("")


def encode_stream_url(url: Column, user: Column | None = None, password: Column | None = None) -> Column:
    """Url with its (or the given) user and password percent-encoded; without a user it stays."""
    quote = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    scheme = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    info = F.regexp_extract(url, "^[^/]*//([^/?#]*)@", 1)
    user = F.nullif(F.regexp_extract(info, "^([^:]*)", 1), F.lit("")) if user is None else user
    password = F.regexp_extract(info, "^[^:]*:(.*)$", 1) if password is None else F.coalesce(password, F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[^/]*//(?:[^/?#]*@)?([^/?#:]*)", 1))
    tail = F.regexp_extract(url, "^[^/]*//(?:[^/?#]*@)?[^/?#:]*(.*)$", 1)
    made = F.concat(scheme, F.lit("://"), quote(user), F.lit(":"), quote(password), F.lit("@"), host, tail)
    return F.when(user.isNotNull() & (user != ""), made).otherwise(url)


def parse_scopes(df: DataFrame, col: str = "scopes") -> DataFrame:
    """Name and hardware (the last that fits) and profiles of a list of scope addresses."""
    of = lambda kind: F.transform(F.filter(col, lambda s: F.contains(s, F.lit(f"/{kind}/"))), lambda s: F.element_at(F.split(s, "/"), -1))
    return df.withColumns({"scope_name": F.try_element_at(of("name"), F.lit(-1)), "hardware": F.try_element_at(of("hardware"), F.lit(-1)), "profiles": of("Profile")})
