"""Documents as columns: canonical JSON, hashes, presets, messages, decision maps and request fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of generator settings, and of the model, that a settings hash covers.
GENERATOR_KEYS = (
    "points_per_side", "points_per_batch", "pred_iou_thresh", "stability_score_thresh", "box_nms_thresh",
    "crop_n_layers", "crop_n_points_downscale_factor", "min_mask_region_area", "use_m2m", "multimask_output",
)
MODEL_KEYS = ("model_id", "sam2_commit", "checkpoint_fingerprint")
#: The score from which a region's guide counts, and the memory planned for masks in bytes.
GUIDE_HIGH, MASK_BUDGET = 0.15, 2000 * 1024 * 1024
#: Exit codes of a setup, and the edit mode of each tool and operation.
EXIT_OK, EXIT_EXTENSION, EXIT_CHECKPOINT = 0, 3, 4
EDIT_MODES = {
    ("pan", "add"): "pan", ("pan", "remove"): "pan", ("brush", "add"): "brush", ("brush", "remove"): "brush",
    ("ai_click", "add"): "ai_prompt", ("ai_click", "remove"): "ai_prompt", ("rectangle", "add"): "rect_add", ("rectangle", "remove"): "rect_del",
    ("polygon", "add"): "poly_add", ("polygon", "remove"): "poly_del",
}


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in order, without spaces, with nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def settings_hash(generator: dict[str, Column], model: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of the settings and the model; keys that are not given are null."""
    missing = F.lit(None).cast("string")
    parts = {"generator": (GENERATOR_KEYS, generator), "model": (MODEL_KEYS, model)}
    document = {name: F.struct(*[given.get(k, missing).alias(k) for k in sorted(keys)]) for name, (keys, given) in parts.items()}
    return F.sha2(canonical_json(document), 256)


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes."""
    return F.sha2(content, 256)


def iso_time(at: Column) -> Column:
    """UTC time with microseconds and offset."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def preset_of(settings: dict[str, Column], presets: dict[str, dict[str, object]]) -> Column:
    """The first preset whose every key has the same value, else ``custom``; nulls equal nulls."""
    out = F.lit("custom")
    for name, values in reversed(presets.items()):
        same = F.lit(True)
        for key, value in values.items():
            same &= settings[key].eqNullSafe(F.lit(value))
        out = F.when(same, name).otherwise(out)
    return out


def points_per_batch(requested: Column, height: Column, width: Column, several: Column, budget: int = MASK_BUDGET) -> Column:
    """Points for which the masks fit the budget, the requested number at most and one at least."""
    wanted = F.greatest(F.lit(1), requested).cast("long")
    each = F.when(several, 3).otherwise(1).cast("long") * height.cast("long") * width.cast("long") * 4
    fitting = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.when(each > 0, each)).cast("long"))
    return F.when(each <= 0, wanted).otherwise(F.least(wanted, fitting))


def with_decision(decisions: Column, member: Column, decision: Column, sparse: bool = False) -> Column:
    """A map of decisions with one set; a sparse map drops ``unreviewed``."""
    others = F.map_filter(decisions, lambda k, v: k != member)
    added = F.map_concat(others, F.create_map(member, decision))
    return F.when(decision == "unreviewed", others).otherwise(added) if sparse else added


def default_decisions(members: Column) -> Column:
    """A map of all members to ``unreviewed``."""
    return F.map_from_arrays(members, F.transform(members, lambda m: F.lit("unreviewed")))


def only_removed(decisions: Column) -> Column:
    """The members of a map that are removed, in order."""
    return F.array_sort(F.map_keys(F.map_filter(decisions, lambda k, v: v == "remove")))


def valid_decisions(decisions: Column, count: Column) -> Column:
    """Decisions on nodes 1 to count, without ``unreviewed``."""
    return F.map_filter(decisions, lambda k, v: (v != "unreviewed") & (k >= 1) & (k <= count))


def valid_actions(actions: Column, members: Column) -> Column:
    """Candidate actions of known members: ``add`` and ``remove`` only."""
    return F.map_filter(actions, lambda k, v: v.isin("add", "remove") & F.array_contains(members, k))


def valid_ids(explicit: Column, listed: Column, decided: Column) -> Column:
    """Ids by the first of the three that is not missing; an empty list counts as missing, an empty argument does not."""
    return F.coalesce(explicit, F.when(F.size(listed) > 0, listed), decided)


def all_true(flags: Column, keys: tuple[str, ...]) -> Column:
    """Whether a map holds true for all keys."""
    return F.forall(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.try_element_at(flags, k), F.lit(False)))


def request(command: Column, request_id: Column, version: int, **fields: Column) -> Column:
    """A request as one line of JSON."""
    head = {"protocol_version": F.lit(version), "request_id": request_id, "command": command}
    return F.to_json(F.struct(*[v.alias(k) for k, v in (head | fields).items()]))


def event(name: Column, version: int, request_id: Column | None = None, job_id: Column | None = None, **fields: Column) -> Column:
    """A worker's event as one line of JSON; ids that are null are left out."""
    head = {"protocol_version": F.lit(version), "status": F.lit("ok"), "event": name}
    return _message(head, request_id, fields, job_id)


def error(code: Column, text: Column, version: int, request_id: Column | None = None, job_id: Column | None = None, **fields: Column) -> Column:
    """A worker's error as one line of JSON; ids that are null are left out."""
    head = {"protocol_version": F.lit(version), "status": F.lit("error"), "event": F.lit("error"), "error_code": code, "message": text}
    return _message(head, request_id, fields, job_id)


def _message(head: dict[str, Column], request_id: Column | None, fields: dict[str, Column], job_id: Column | None) -> Column:
    ids = {} if request_id is None else {"request_id": request_id}
    job = {} if job_id is None else {"job_id": job_id}
    return F.to_json(F.struct(*[v.alias(k) for k, v in (head | ids | fields | job).items()]))


def exit_code(imported: Column, checkpoint: Column, build_only: Column, executed: Column, verified: Column) -> Column:
    """Exit code of a setup by the first step that fails."""
    return F.when(~imported, EXIT_EXTENSION).when(build_only, EXIT_OK).when(~checkpoint, EXIT_CHECKPOINT).when(~executed | ~verified, EXIT_EXTENSION).otherwise(EXIT_OK)


def error_code(kind: Column) -> Column:
    """The error code of a kind of failure."""
    return (
        F.when(kind == "image_load", "IMAGE_LOAD_FAILED").when(kind == "rle", "RLE_INVALID").when(kind == "result_write", "RESULT_WRITE_FAILED")
        .when(kind == "out_of_memory", "GPU_OOM").otherwise("GENERATION_FAILED")
    )


def guide_disagreement(id_a: Column, score_a: Column, id_b: Column, score_b: Column) -> Column:
    """0 if both regions have a strong guide and it is the same, 1 if it differs, else 0.5."""
    strong = (id_a != 0) & (score_a >= GUIDE_HIGH) & (id_b != 0) & (score_b >= GUIDE_HIGH)
    return F.when(strong, F.when(id_a == id_b, 0.0).otherwise(1.0)).otherwise(0.5)


def edit_mode(tool: Column, operation: Column) -> Column:
    """The edit mode of a tool and an operation; null where there is none."""
    out = F.lit(None).cast("string")
    for (t, o), mode in EDIT_MODES.items():
        out = F.when((tool == t) & (operation == o), mode).otherwise(out)
    return out


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its corners in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def region_of_interest(x: Column, y: Column, w: Column, h: Column, width: int, height: int, margin: int, share: float) -> Column:
    """A box with a margin, clipped to the image; null where less than four pixels are left in a direction."""
    mx, my = F.greatest(F.lit(margin), F.floor(w * share)), F.greatest(F.lit(margin), F.floor(h * share))
    x0, y0 = F.greatest(F.lit(0), x - mx), F.greatest(F.lit(0), y - my)
    rw, rh = F.least(F.lit(width), x + w + mx) - x0, F.least(F.lit(height), y + h + my) - y0
    made = F.struct(*[v.cast("long").alias(n) for v, n in ((x0, "x"), (y0, "y"), (rw, "w"), (rh, "h"))])
    return F.when((rw >= 4) & (rh >= 4), made)


def scaled_points(points: Column, roi: Column, scale: float, width: Column, height: Column) -> Column:
    """Points of a stroke inside the region, in its scaled coordinates, rounded half to even and clipped."""
    inside = F.filter(points, lambda p: (p["x"] >= roi["x"]) & (p["x"] < roi["x"] + roi["w"]) & (p["y"] >= roi["y"]) & (p["y"] < roi["y"] + roi["h"]))

    def place(v: Column, origin: Column, side: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.bround((v - origin) * F.lit(scale), 0).cast("long"), side - 1))

    return F.transform(inside, lambda p: F.struct(place(p["x"], roi["x"], width).alias("x"), place(p["y"], roi["y"], height).alias("y")))


def overlaid(given: Column, default: Column) -> Column:
    """A setting with its default where it is not given."""
    return F.coalesce(given, default)


def clamped(text: Column, default: int, low: int, high: int) -> Column:
    """A stored setting as a number between its limits; its default where it is missing or no number."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(text.try_cast("int"), F.lit(default))))


def first_best(scores: Column) -> Column:
    """The index of the largest of the scores, the first of equals; null for none."""
    pairs = F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("i")))
    return (-F.array_max(pairs)["i"]).cast("long")


def edited_path(rel: Column) -> Column:
    """Where an edited mask goes: the same place, as .png."""
    return F.concat(F.lit("masks_edited/"), _as_png(rel))


def default_path(rel: Column) -> Column:
    return F.concat(F.lit("masks/"), _as_png(rel))


def save_path(rel: Column, existing: Column) -> Column:
    """Where a mask is saved: over the existing one, if there is one."""
    return F.coalesce(existing, default_path(rel))


def export_path(rel: Column) -> Column:
    """Where an exported mask goes: the file's whole name and .png."""
    return F.concat(F.lit("masks_colmap/"), rel, F.lit(".png"))


def _as_png(rel: Column) -> Column:
    return F.concat(F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", ""), F.lit(".png"))
