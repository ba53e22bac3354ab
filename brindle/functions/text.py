"""Text and path rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets in order of precedence, and the wording of prefixes and markdown that outputs may carry.
BUCKETS = ("goal", "full", "wentwrong")
PREFIX = r"(?i)^\s*(?:(?:enhanced|rewritten|revised)\s+)?caption\s*:\s*"
MARKDOWN = r"\*\*|__|`|^#{1,6}\s|^\s*[-*]\s"
RATIO_LOW, RATIO_HIGH = 0.75, 1.35


def blank_to_null(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t != "", t)


def text_key(x: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\s+", " "), "^ | $", "")


def caption(enhanced: Column, base: Column) -> Column:
    """Enhanced text unless blank, else the base text; empty if neither."""
    return F.coalesce(blank_to_null(enhanced), blank_to_null(base), F.lit(""))


def bucket_of_path(path: Column, unknown: str | None = "unknown") -> Column:
    """First of BUCKETS that is a folder of the path; `unknown`, or an error if that is None."""
    p = F.concat(F.lit("/"), F.translate(path, "\\", "/"))
    out = F.coalesce(*[F.when(p.contains(f"/{b}/"), F.lit(b)) for b in BUCKETS])
    return F.coalesce(out, F.lit(unknown) if unknown is not None else F.raise_error(F.concat(F.lit("no bucket in "), path)).cast("string"))


def webp_path(path: Column, root: str = "") -> Column:
    """Forward slashes, no leading train/, suffix .webp, below `root`."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^train/", "")
    return F.concat(F.lit(root), F.regexp_replace(p, r"\.[^./]+$", ".webp"))


def source_path(path: Column, data_root: str, image_root: str) -> Column:
    """Where an image named in the annotations lies: below the data folder's parent, the data folder or the image folder,
    by how its name begins; an absolute path stays."""
    p = F.translate(path, "\\", "/")
    parent = data_root.rstrip("/").rpartition("/")[0]
    return (
        F.when(p.startswith("data/train_webp/"), F.concat(F.lit(f"{parent}/"), p))
        .when(p.startswith("train_webp/"), F.concat(F.lit(f"{data_root}/"), p))
        .when(p.startswith("imgs_"), F.concat(F.lit(f"{image_root}/"), p))
        .when(p.startswith("train/"), webp_path(p, f"{image_root}/"))
        .when(p.startswith("/"), p)
        .otherwise(F.concat(F.lit(f"{data_root}/"), p))
    )


def output_path(path: Column) -> Column:
    """An image's place in a subset, below train_webp, whatever form its name in the annotations has."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^data/", "")
    inner = F.regexp_extract(p, "(?:^|/)(train_webp/.*)$", 1)
    return (
        F.when(p.startswith("train_webp/"), p)
        .when(p.startswith("imgs_"), F.concat(F.lit("train_webp/"), p))
        .when(p.startswith("train/"), webp_path(p, "train_webp/"))
        .when(inner != "", inner)
        .otherwise(F.concat(F.lit("train_webp/"), F.regexp_extract(p, "([^/]*)$", 1)))
    )


def label_info(anomaly: Column, normal: Column, otherwise: str = "unknown") -> Column:
    """struct(label_type, label): anomaly wins over normal, then `otherwise` with an empty label."""
    return (
        F.when(anomaly.isNotNull(), F.struct(F.lit("anomaly").alias("label_type"), anomaly.alias("label")))
        .when(normal.isNotNull(), F.struct(F.lit("normal").alias("label_type"), normal.alias("label")))
        .otherwise(F.struct(F.lit(otherwise).alias("label_type"), F.lit("").alias("label")))
    )


def caption_hash(x: Column) -> Column:
    """60-bit hash of the trimmed lower-case caption; only equality matters."""
    return F.conv(F.substring(F.sha2(F.lower(F.trim(x)).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def cache_key(image_id: Column, hashed: Column) -> Column:
    return F.concat(image_id.cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(hashed), 16, "0")))


def stable_key(seed, split, purpose, key: Column) -> Column:
    """Hash that orders rows the same way in every run: sha256 of seed:split:purpose:id."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(str(v))
    return F.sha2(F.concat_ws(":", lit(seed), lit(split), lit(purpose), key.cast("string")).cast("binary"), 256)


def n_tokens(x: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))


def has_markdown(x: Column) -> Column:
    return x.rlike(MARKDOWN)


def clean_generation(x: Column) -> Column:
    """A generated caption without prefix, emphasis, backticks, surrounding quotes and repeated white space."""
    t = F.regexp_replace(F.trim(x), PREFIX, "")
    t = F.regexp_replace(t, r"^(?:\*\*|__)(.*)(?:\*\*|__)$", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\*\*|__|\*", ""), "^`+|`+$", "")
    t = F.regexp_replace(t, "^\"(.*)\"$", "$1")
    t = F.regexp_replace(t, "^'(.*)'$", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def output_is_bad(original: Column, output: Column) -> Column:
    """Blank, with markdown, or outside the token ratio (which counts only if the original has tokens)."""
    n, m = n_tokens(original), n_tokens(output)
    return (F.trim(output) == "") | has_markdown(output) | ((n > 0) & ~F.try_divide(m, n).between(RATIO_LOW, RATIO_HIGH))  # Spark may divide before it looks at n


def finalize(original: Column, raw: Column, label_type: Column) -> Column:
    """The output to keep: the original if the output is empty or has markdown, and for anomalies if the gate rejects it."""
    cleaned = clean_generation(raw)
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", original)
        .when(has_markdown(raw), original)
        .when((label_type == "anomaly") & output_is_bad(original, cleaned), original)
        .when(cleaned == "", original)
        .otherwise(cleaned)
    )


def hard_score(bucket: Column, hard_bucket: Column, video: Column, hard_video: Column, action: Column, hard_action: Column, scene: Column, hard_scene: Column) -> Column:
    """Difficulty of a pair: 5 for goal against full or wentwrong, 2 same video, 2 other action, 1.5 same scene."""
    against = ((bucket == "goal") & hard_bucket.isin("full", "wentwrong")) | ((hard_bucket == "goal") & bucket.isin("full", "wentwrong"))
    points = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    return points(against, 5.0) + points(video == hard_video, 2.0) + points(~action.eqNullSafe(hard_action), 2.0) + points((scene == hard_scene) & (scene.cast("string") != ""), 1.5)


def edge_relation(video: Column, hard_video: Column, bucket: Column, hard_bucket: Column, action: Column, hard_action: Column, scene: Column, hard_scene: Column) -> Column:
    """Tags of what a pair shares and what not, in fixed order."""
    return F.array_compact(F.array(
        F.when(video == hard_video, F.lit("same_video")),
        F.when(bucket != hard_bucket, F.lit("cross_bucket")),
        F.when(~action.eqNullSafe(hard_action), F.lit("action_changed")),
        F.when(scene == hard_scene, F.lit("same_scene")),
    ))


def prompt(label_type: Column, action: Column, source: Column, original: Column) -> Column:
    return F.format_string("Rewrite the caption. Label: %s. Action: %s. Source: %s. Caption: %s", label_type, action, source, original)


def tokenize(x: Column, vocabulary: int = 30522, length: int = 100) -> Column:
    """Hash ids between a start (1) and an end (2) mark, padded with 0 to `length`."""
    ids = F.transform(F.slice(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), 1, length - 2), lambda w: (F.conv(F.substring(F.sha2(w.cast("binary"), 256), 1, 8), 16, 10).cast("long") % (vocabulary - 5) + 5).cast("int"))
    body = F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2)))
    return F.concat(body, F.array_repeat(F.lit(0), F.lit(length) - F.size(body)))


def attention_mask(ids: Column) -> Column:
    """1 for each id of `tokenize`, 0 for padding."""
    return F.transform(ids, lambda k: (k != 0).cast("int"))
