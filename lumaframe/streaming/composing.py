"""Frames of animations that arrive in any order and in any number of pieces, shown as soon as they can be."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumaframe.kernels import compose
from lumaframe.sources import images

#: What the state keeps of an image: the number that comes next, the canvas, the frame shown last, the frames that wait
#: for earlier ones as an Arrow stream, and whether a corrupt frame has ended it.
STATE = "next int, canvas binary, x int, y int, width int, height int, dispose boolean, waiting binary, ended boolean"
PLACED = [*images.PLACE, "frame_count"]


def _packed(rows: list[dict]) -> bytes | None:
    if not rows:
        return None
    table = pa.Table.from_pylist(rows)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> list[dict]:
    return pa.ipc.open_stream(data).read_all().to_pylist() if data else []


def _picture(r: dict, wishes: images.Wishes) -> np.ndarray:
    if r.get("_corrupt"):
        raise ValueError(r["_corrupt"])
    if r.get("argb") is not None:
        return np.array(r["argb"], np.int64).astype(np.int32).view(np.uint32).reshape(r["height"], r["width"])
    f = SimpleNamespace(**{c: r[c] for c in ("width", "height", "lossless", "alpha", "payload")})
    return compose.decode_frame(f, wishes.lossy, wishes.fancy)


def _content(r: dict) -> tuple:
    """An order of frames with equal numbers that doesn't depend on how they came."""
    return tuple((v is not None, str(v)) for _, v in sorted(r.items()))


def arrivals(wishes: images.Wishes, patience_ms: int | None):
    """What is done with an image's new frames and its state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        image_id = key[0]
        if state.hasTimedOut:
            number, *_, waiting, ended = state.get
            left = _unpacked(waiting)
            state.remove()
            if left and not ended:
                yield _frame([(image_id, number, None, None, None, None, f"frame {number} did not arrive; {len(left)} later ones did")])
            return
        number, canvas_bytes, x, y, width, height, dispose, waiting, ended = state.get if state.exists else (0, None, None, None, None, None, None, None, False)
        held = {r["frame_no"]: r for r in _unpacked(waiting)}
        fresh: dict[int, dict] = {}
        for part in parts:
            for r in part.astype(object).where(part.notna(), None).to_dict("records") if len(part) else []:
                k = int(r["frame_no"])
                if not ended and k >= number and k not in held and (k not in fresh or _content(r) < _content(fresh[k])):
                    fresh[k] = {c: v.tolist() if isinstance(v, np.ndarray) else v for c, v in r.items()}
        held |= fresh
        canvas = None
        while number in held and not ended:
            r = held.pop(number)
            f = SimpleNamespace(**{c: r[c] for c in PLACED})
            if canvas is None:
                canvas = compose.Canvas(int(f.source_width), int(f.source_height))
                if canvas_bytes is not None:
                    canvas.pixels = np.frombuffer(canvas_bytes, np.uint32).reshape(canvas.pixels.shape).copy()
                    canvas.before = SimpleNamespace(x=x, y=y, width=width, height=height, dispose=dispose)
            for c in ("x", "y", "width", "height"):
                setattr(f, c, int(getattr(f, c)))
            try:
                shown = wishes.scaled(canvas.add(f, _picture(r, wishes)), canvas.size)
                row = (image_id, number, shown.shape[1], shown.shape[0], int(f.duration_ms), shown.ravel().view(np.int32).copy(), None)
            except (ValueError, IndexError, MemoryError) as e:
                row, ended = (image_id, number, None, None, None, None, str(e) or type(e).__name__), True
            x, y, width, height, dispose = f.x, f.y, f.width, f.height, bool(f.dispose)
            number += 1
            ended = ended or number == f.frame_count
            yield _frame([row])
        if ended:
            held = {}
        canvas_bytes = None if ended else canvas_bytes if canvas is None else canvas.pixels.tobytes()
        state.update((number, canvas_bytes, x, y, width, height, dispose, _packed([held[k] for k in sorted(held)]), ended))
        if patience_ms is not None:
            state.setTimeoutDuration(patience_ms)

    return run


def compose_arriving(frames: DataFrame, wishes: images.Wishes = images.Wishes(), patience_ms: int | None = None) -> DataFrame:
    """Rows of images.SHOWN, of a stream of frames as frames_encoded gives them, or with argb in place of payload.

    However the frames are dealt over micro-batches and whatever their order, each is shown once, on the canvas that all
    earlier ones have made, as soon as all those are there: the rows are those of images.frames. Of frames with
    the same number the first that arrived counts, within one batch the one first in order of its values; a frame
    that has been shown is passed over if it comes again. A corrupt frame is the last of its image. Rows without an
    image_id or a number are passed over.

    The state holds one canvas and the frames that wait; of an image that is complete or ended, no canvas. With
    patience_ms, an image of which nothing new came for so long is given up: if frames wait, a row with the number of the
    missing frame and _corrupt says so; its state goes, and what comes later begins anew. Spark then runs batches
    without data too, to see to that, so a query that stops when what is there has been read takes no patience."""
    columns = [c for c in (*PLACED, "lossless", "alpha", "payload", "argb", "_corrupt") if c in frames.columns]
    rows = frames.where("image_id is not null and frame_no >= 0").select(*columns)
    limit = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("image_id").applyInPandasWithState(arrivals(wishes, patience_ms), images.SHOWN, STATE, "append", limit)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in images.SHOWN.split(", ")])
    return out.astype({c: "Int32" for c in ("frame_no", "width", "height", "duration_ms")})
