"""Score arriving detections against static allow-lists and prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import Params
from ..operators.similarity import PrototypeBlocks, class_similarities, judge
from ..plans.check import decide_items, one_list


def score_stream(detections: DataFrame, photo_lists: DataFrame, prototypes: DataFrame, params: Params) -> DataFrame:
    """Decisions of a stream of (photo_id, det_id, embedding). Stateless, so it equals the batch result.

    Of a vector and its similarities to all classes the narrower one is carried to the list of its photo.
    """
    blocks, keep, lists = PrototypeBlocks(prototypes), ["photo_id", "det_id"], one_list(photo_lists)
    bytes_each = 4 if detections.schema["embedding"].dataType.elementType.simpleString() == "float" else 8
    if len(blocks.ids) * 8 >= (prototypes.agg(F.max(F.size("vector"))).first()[0] or 0) * bytes_each:
        return decide_items(detections, lists, prototypes, params, keep).drop("list_id")
    compared = class_similarities(detections, blocks, keep)
    return judge(compared.join(lists, "photo_id"), blocks, params, keep, vector="sims", compared=True).drop("list_id")


def run_available(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        scored.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
