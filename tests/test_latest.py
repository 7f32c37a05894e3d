import random
from datetime import datetime, timedelta

import pytest

from pageloom.queries.streams import drained
from pageloom.streaming import latest as L

REQUESTS, RESPONSES = "key long, request_id long, asked timestamp", "key long, request_id long, asked timestamp, answered timestamp, body string"
AT = datetime(2024, 1, 1)


def some(seed):
    rnd, asked = random.Random(seed), []
    for i in range(120):
        asked.append((rnd.randrange(4), i, AT + timedelta(seconds=rnd.randrange(0, 3600, 10))))
    answers = [(*r, r[2] + timedelta(seconds=rnd.randrange(0, 300)), f"b{r[1]}") for r in asked if r[1] % 5]
    fresh = [a for a in answers if not any(r[0] == a[0] and (r[2], r[1]) > (a[2], a[1]) and r[2] <= a[3] for r in asked)]
    return asked, answers, sorted(a[1] for a in fresh)


@pytest.mark.parametrize("seed", range(3))
def test_batch_against_all_pairs(spark, seed):
    asked, answers, fresh = some(seed)
    got = L.current_responses(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame([*answers, (1, 999, AT, None, "")], RESPONSES))
    assert 0 < len(fresh) < len(answers) and sorted(r.request_id for r in got.collect()) == fresh


def test_stream_with_rows_out_of_order(spark, tmp_path):
    asked, answers, fresh = some(7)
    end = AT + timedelta(days=1)
    for i in range(3):  # of each file's rows some are older than those of the file before
        spark.createDataFrame([r for r in asked if r[1] * 7 % 3 == i] + [(9, 1000, end)][: i // 2], REQUESTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        spark.createDataFrame([r for r in answers if r[1] * 5 % 3 == i] + [(9, 1000, end, end, "")][: i // 2], RESPONSES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/answers")
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    got = drained(L.current_responses_stream(read(REQUESTS, "asked"), read(RESPONSES, "answers"), late="3 hours", within="10 minutes")).collect()
    assert sorted(r.request_id for r in got if r.request_id < 1000) == fresh
