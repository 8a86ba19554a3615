"""Argument lists of encoders, as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.params import clamp, short
from cadenza.functions.text import keyint, preset_number

#: The flags of the encoders with a key=value list, and what it ends with (fixed values).
PARAMETER_FLAG = {"libx265": "-x265-params", "libx264": "-x264-params"}
MORE_PARAMETERS = {"libx265": "log-level=error"}
NVENC = ("hevc_nvenc", "av1_nvenc", "h264_nvenc")


def _list(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def argv(encoder: str, request: dict[str, Column], space: dict[str, Column]) -> Column:
    """The arguments of one encode. request: program, input, output, pix_fmt, preset, crf, aq_mode, aq_strength, fps, seconds (between
    key frames), threads and loglevel, and extra, if any: an array of arguments that go before the output. The parameters are moved into the space first."""
    p = clamp(request["crf"], request["aq_mode"], request["aq_strength"], space)
    crf, mode, strength = short(p["crf"]), p["aq_mode"].cast("string"), short(p["aq_strength"])
    key = keyint(request["fps"], request["seconds"]).cast("string")
    whole = p["aq_strength"].cast("int").cast("string")
    some = _list().cast("array<string>")
    head = _list(request["program"], "-hide_banner", "-nostdin", "-y", "-loglevel", request["loglevel"], "-i", request["input"], "-map", "0:v:0", "-an", "-sn", "-dn")
    codec = _list("-c:v", encoder, "-pix_fmt", request["pix_fmt"])
    preset = lambda named: F.when(F.coalesce(request["preset"], F.lit("")) != "", _list("-preset", named)).otherwise(some)
    if encoder in PARAMETER_FLAG:
        pairs = [F.concat(F.lit("aq-mode="), mode), F.concat(F.lit("aq-strength="), strength), F.concat(F.lit("keyint="), key), F.concat(F.lit("min-keyint="), key), F.lit("scenecut=0")]
        pairs += [F.lit(MORE_PARAMETERS[encoder])] if encoder in MORE_PARAMETERS else []
        middle = F.concat(codec, _list("-preset", request["preset"], "-crf", crf, PARAMETER_FLAG[encoder], F.concat_ws(":", *pairs)))
    elif encoder == "libsvtav1":
        svt = F.concat(F.lit("enable-variance-boost="), mode, F.lit(":variance-boost-strength="), whole, F.lit(":keyint="), key, F.lit(":scd=0"))
        middle = F.concat(_list("-fps_mode", "passthrough"), codec, _list("-preset", preset_number(request["preset"]).cast("string"), "-crf", crf, "-svtav1-params", svt))
    else:
        if encoder in NVENC:
            on = p["aq_mode"] > 0
            quality = F.concat(_list("-rc", "vbr", "-cq", crf, "-b:v", "0", "-spatial-aq", F.when(on, "1").otherwise("0")), F.when(on, _list("-aq-strength", whole)).otherwise(some))
        else:
            quality = _list("-crf", crf)
        middle = F.concat(codec, preset(request["preset"]), quality, _list("-g", key, "-keyint_min", key, "-sc_threshold", "0"))
    threads = F.when(request["threads"] > 0, _list("-threads", request["threads"].cast("string"))).otherwise(some)
    extra = F.coalesce(request.get("extra", some), some)
    return F.concat(head, middle, threads, extra, _list(request["output"]))
