import pytest
from pyspark.sql import functions as F

from featurelake.sources import logs
from featurelake.sources.offline import OfflineStore
from featurelake.sources.registry import FEATURE_SCHEMA, MEMBER_SCHEMA, FeatureRegistry
from featurelake.sources.serving import ServingStore
from featurelake.sources.store import FeatureStore


@pytest.fixture
def small(spark):
    return spark.createDataFrame(
        [(1, 7.0, 6.0, "Ametista"), (2, 8.0, 7.0, "Topázio"), (3, 5.0, 4.0, "Quartzo"), (4, 6.0, 5.0, "Ametista")],
        "aluno_id long, INDE double, IPV double, PEDRA string")


# -- offline -----------------------------------------------------------------------------------------


def test_ingest_logs_a_version(spark, small, base):
    store = OfflineStore(spark, base)
    path = store.ingest(small, "d", "aluno_id", version="v1")
    row = store.list_versions("d").first()
    assert (row["version"], row.num_rows, row.num_columns, row.path) == ("v1", 4, 4, path)
    assert row.columns == small.columns
    assert store.get_dataset("d").count() == 4


def test_latest_is_the_last_ingested(spark, small, base):
    store = OfflineStore(spark, base)
    store.ingest(small, "d", "aluno_id", version="2")
    store.ingest(small.limit(1), "d", "aluno_id", version="10")
    store.ingest(small.limit(2), "d", "aluno_id", version="1")
    assert store.get_dataset("d").count() == 2 and store.get_dataset("d", "10").count() == 1
    assert [r["version"] for r in store.latest_versions().collect()] == ["1"]


def test_a_version_is_immutable(spark, small, base):
    store = OfflineStore(spark, base)
    store.ingest(small, "d", "aluno_id", version="1")
    with pytest.raises(ValueError):
        store.ingest(small, "d", "aluno_id", version="1")


def test_filters_cover_in_equality_and_unknown_columns(spark, small, base):
    store = OfflineStore(spark, base)
    store.ingest(small, "d", "aluno_id")
    out = store.get_dataset("d", filters={"aluno_id": [1, 2, 99], "PEDRA": "Ametista", "unknown": 5})
    assert [r.aluno_id for r in out.collect()] == [1]


def test_filter_on_an_unprojected_column_is_honoured_and_pushed(spark, small, base):
    store = OfflineStore(spark, base)
    store.ingest(small, "d", "aluno_id")
    out = store.get_dataset("d", columns=["INDE"], filters={"aluno_id": [2]})
    assert out.columns == ["INDE"] and [r.INDE for r in out.collect()] == [8.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "aluno_id" in plan.split("PushedFilters")[1] and "IPV" not in plan.split("ReadSchema")[1]


def test_missing_data_sets_and_versions(spark, small, base):
    store = OfflineStore(spark, base)
    with pytest.raises(ValueError):
        store.get_dataset("d")
    store.ingest(small, "d", "aluno_id", version="1")
    with pytest.raises(ValueError):
        store.get_dataset("d", "2")
    assert store.list_versions("none").count() == 0 and store.get_dataset_info("none") is None
    assert store.get_dataset_info("d")["entity_column"] == "aluno_id"


def test_delete_version(spark, small, base):
    store = OfflineStore(spark, base)
    path = store.ingest(small, "d", "aluno_id", version="1")
    store.ingest(small, "d", "aluno_id", version="2")
    assert store.delete_version("d", "1") and not store.delete_version("d", "1") and not store.delete_version("x", "1")
    assert [r["version"] for r in store.list_versions("d").collect()] == ["2"]
    from featurelake.sources.files import path_exists

    assert not path_exists(spark, path)
    store.delete_version("d", "2")
    assert [r.dataset for r in store.list_datasets().collect()] == ["d"]


# -- serving -----------------------------------------------------------------------------------------


def test_materialise_replaces_and_keeps_the_creation_time(spark, small, base):
    store = ServingStore(spark, base)
    assert store.materialize(small, "t", "aluno_id") == 4
    first = store.get_table_info("t")
    assert store.materialize(small.limit(2), "t", "aluno_id", ["INDE"]) == 2
    info = store.get_table_info("t")
    assert info["num_rows"] == 2 and info["feature_columns"] == ["INDE"]
    assert info["created_at"] == first["created_at"] and info["updated_at"] > first["updated_at"]
    assert store.drop_old_generations("t") == 1 and store.table("t").count() == 2


def test_lookup_absent_and_repeated_ids(spark, small, base):
    store = ServingStore(spark, base)
    store.materialize(small, "t", "aluno_id")
    by_list = store.get_features("t", [1, 1, 3, 99], ["INDE"])
    assert by_list.columns == ["aluno_id", "INDE"] and sorted(r.aluno_id for r in by_list.collect()) == [1, 3]
    ids = spark.createDataFrame([(1,), (1,), (3,), (99,)], "id long")
    assert sorted(r.aluno_id for r in store.get_features("t", ids).collect()) == [1, 3]
    assert store.access_log().count() == 8
    assert store.access_log().where("entity_id = '99'").count() == 2
    with pytest.raises(ValueError):
        store.get_features("none", [1])


def test_vector(spark, small, base):
    store = ServingStore(spark, base)
    store.materialize(small, "t", "aluno_id")
    assert store.get_feature_vector("t", 2, ["INDE", "PEDRA"]) == {"aluno_id": 2, "INDE": 8.0, "PEDRA": "Topázio"}
    assert store.get_feature_vector("t", 77) == {}


def test_drop_table(spark, small, base):
    store = ServingStore(spark, base)
    store.materialize(small, "t", "aluno_id")
    assert store.delete_table("t") and store.delete_table("never")
    assert store.get_table_info("t") is None and store.list_tables().count() == 0


def test_lookup_by_list_is_pushed_down(spark, small, base):
    store = ServingStore(spark, base)
    store.materialize(small, "t", "aluno_id")
    plan = store.get_features("t", [1, 2], log_access=False)._jdf.queryExecution().executedPlan().toString()
    assert "In(aluno_id" in plan.split("PushedFilters")[1]


# -- registry ----------------------------------------------------------------------------------------


def test_default_registry(spark):
    reg = FeatureRegistry.default(spark)
    assert reg.list_features().count() == 14
    assert {r.group_name: r.members for r in reg.list_groups().collect()} == {
        "indices_avaliacao": 8, "demografico": 4, "ponto_virada_features": 14}
    assert reg.source_columns("demografico") == ["IDADE_ALUNO", "ANOS_PM", "INSTITUICAO_ENSINO_ALUNO", "BOLSISTA"]
    assert reg.source_columns("none") is None


@pytest.mark.parametrize("tag", ["index", "indice", "Índice", "  INDICES "])
def test_tags_ignore_accents_case_and_aliases(spark, tag):
    assert FeatureRegistry.default(spark).features_by_tag(tag).count() == 8


def test_empty_and_unknown_tags(spark):
    reg = FeatureRegistry.default(spark)
    assert reg.features_by_tag("").count() == 0 and reg.features_by_tag("  ").count() == 0
    assert reg.features_by_tag("none").count() == 0


def test_upserts_and_members_without_definition(spark, base):
    reg = FeatureRegistry.default(spark)
    changed = spark.createDataFrame([("inde", "numeric", "d", "OTHER", "t", "2.0.0", ["x"])], FEATURE_SCHEMA)
    group = spark.createDataFrame([("demografico", "aluno", 0, "inde"), ("demografico", "aluno", 1, "ghost")], MEMBER_SCHEMA)
    new = reg.register_features(changed).register_group(group)
    assert new.list_features().count() == 14 and new.source_columns("demografico") == ["OTHER"]
    new.save(base)
    assert FeatureRegistry.load(spark, base).source_columns("demografico") == ["OTHER"]


# -- facade ------------------------------------------------------------------------------------------


def test_feature_store_round_trip(spark, base):
    df = spark.createDataFrame([(i, *[float(i)] * 8, 1) for i in range(3)],
                               "aluno_id int, INDE double, IAA double, IEG double, IPS double, IDA double, IPP double, "
                               "IPV double, IAN double, ponto_virada_pred int")
    store = FeatureStore(spark, base)
    store.ingest_training_data(df, "train", "aluno_id", "v1")
    assert store.get_training_data("train", group="indices_avaliacao").columns == [
        "INDE", "IAA", "IEG", "IPS", "IDA", "IPP", "IPV", "IAN"]
    assert store.get_training_data("train", group="none").columns == df.columns
    pair = store.get_features_for_training("train", "indices_avaliacao", "ponto_virada_pred")
    assert pair.columns[-1] == "ponto_virada_pred" and len(pair.columns) == 9
    with pytest.raises(ValueError):
        store.get_features_for_training("train", "none", "ponto_virada_pred")
    assert store.materialize_for_serving(df, "t", "aluno_id", "ponto_virada_features") == 3
    assert "ponto_virada_pred" not in store.serving.table("t").columns
    assert store.sync_offline_to_serving("train", "s", "aluno_id") == 3
    assert store.get_serving_features("t", [1], "indices_avaliacao").columns[0] == "aluno_id"
    assert all(r.is_consistent for r in store.validate_consistency("train", "s", "aluno_id").collect())
    status = {(r["item"], r["name"]): r["n"] for r in store.status().collect()}
    assert status[("features", None)] == 14 and status[("dataset", "train")] == 1 and status[("table", "s")] == 3


# -- logs --------------------------------------------------------------------------------------------


def test_logs_append_and_tail(spark, base):
    assert logs.read_log(spark, base, logs.PREDICTION_SCHEMA).count() == 0
    for part in (range(0, 5), range(5, 9)):
        scored = spark.createDataFrame([(f"p{i}", i % 2, i) for i in part], "prediction_id string, prediction int, s int")
        scored = scored.withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz")).withColumn("x", F.lit(1.5))
        logs.append_log(logs.prediction_records(scored, ["x"]), base)
    log = logs.read_log(spark, base, logs.PREDICTION_SCHEMA)
    assert log.count() == 9 and log.where("input['x'] = '1.5'").count() == 9
    assert [r.prediction_id for r in logs.recent_predictions(spark, base, 3).collect()] == ["p8", "p7", "p6"]


def test_blank_lines_are_skipped(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"prediction_id": "a", "actual_outcome": 1}\n\n\n{"prediction_id": "b"}\n')
    log = logs.read_log(spark, str(tmp_path), logs.FEEDBACK_SCHEMA)
    assert sorted(r.prediction_id for r in log.collect()) == ["a", "b"]
    assert log.where("was_correct IS NULL").count() == 2


# -- commits -----------------------------------------------------------------------------------------


def test_commits_are_numbered_and_survive_a_checkpoint(spark, base, monkeypatch):
    from featurelake.sources import commits

    monkeypatch.setattr(commits, "CHECKPOINT", 3)
    log = commits.CommitLog(spark, f"{base}/log", "name string")
    assert log.read().count() == 0 and log.last() == 0
    for i in range(7):
        assert log.commit(lambda number: {"name": f"c{number}"}, 0) == i + 1
    assert [(r.seq, r.name) for r in log.read().orderBy("seq").collect()] == [(i, f"c{i}") for i in range(1, 8)]
    assert log._checkpoints() == [3, 6] and [r["seq"] for r in log.since(5)] == [6, 7]


def test_a_number_is_taken_once(spark, base):
    from concurrent.futures import ThreadPoolExecutor

    from featurelake.sources.commits import CommitLog
    from featurelake.sources.files import child_names, put_if_absent, read_text

    log = CommitLog(spark, f"{base}/log with blank", "writer int")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda w: log.commit(lambda n: {"writer": w}, 0), range(16)))
    assert sorted(numbers) == list(range(1, 17)) and sorted(r.writer for r in log.read().collect()) == list(range(16))
    assert not put_if_absent(spark, log._file(1), "other") and "writer" in read_text(spark, log._file(1))
    assert not [n for n, _ in child_names(spark, log.path) if n.startswith("_draft")]


def test_of_two_writers_of_one_version_one_wins(spark, small, base):
    """The second writer ingests and commits while the first one stands between its data and its commit."""
    one, two = OfflineStore(spark, base), OfflineStore(spark, base)
    commit = one.commits.commit

    def late(*args):
        two.ingest(small.limit(1), "d", "aluno_id", version="1")
        two.ingest(small, "e", "aluno_id", version="1")
        return commit(*args)

    one.commits.commit = late
    with pytest.raises(ValueError, match="another writer"):
        one.ingest(small, "d", "aluno_id", version="1")
    one.commits.commit = commit
    assert one.get_dataset("d").count() == 1 and one.manifest().count() == 2
    from datetime import timedelta

    assert one.clean_up(timedelta(0)) == 0


def test_data_without_a_commit_is_invisible_and_cleaned(spark, small, base):
    from datetime import timedelta

    store = OfflineStore(spark, base)
    store.ingest(small, "d", "aluno_id", version="1")
    commit = store.commits.commit
    store.commits.commit = lambda *args: (_ for _ in ()).throw(OSError("driver lost"))
    with pytest.raises(OSError):
        store.ingest(small, "d", "aluno_id", version="2")
    with pytest.raises(OSError):
        store.delete_version("d", "1")
    store.commits.commit = commit
    again = OfflineStore(spark, base)
    assert [r["version"] for r in again.list_versions("d").collect()] == ["1"] and again.get_dataset("d").count() == 4
    assert again.clean_up() == 0 and again.clean_up(timedelta(0)) == 1
    again.ingest(small.limit(2), "d", "aluno_id", version="2")
    assert again.get_dataset("d").count() == 2
    remove = __import__("featurelake.sources.offline", fromlist=["remove_path"])
    kept, remove.remove_path = remove.remove_path, lambda *args: (_ for _ in ()).throw(OSError("driver lost"))
    try:
        with pytest.raises(OSError):
            again.delete_version("d", "2")
    finally:
        remove.remove_path = kept
    assert [r["version"] for r in again.list_versions("d").collect()] == ["1"] and again.clean_up(timedelta(0)) == 1


# -- logs by day -------------------------------------------------------------------------------------


def _records(spark, low, high):
    """Ten records a day from 2024-01-01 on; the one with id 5 has no time."""
    return spark.range(low, high).select(
        F.lit("feedback").alias("type"),
        F.when(F.col("id") != 5, F.timestamp_seconds(1704067200 + F.col("id") * 8640)).cast("timestamp_ntz").alias("timestamp"),
        F.format_string("%04d", "id").alias("prediction_id"), F.lit(1).alias("actual_outcome"), F.lit("a\nb").alias("comment"),
        F.lit(True).alias("was_correct"))


def _ids(df):
    return sorted(int(r.prediction_id) for r in df.collect())


def test_last_records_list_only_the_newest_days(spark, base):
    logs.append_log(_records(spark, 0, 100), base)
    logs.append_log(_records(spark, 100, 200), base)
    got = logs.recent_feedback(spark, base, 25)
    assert _ids(got) == list(range(175, 200))
    files = got.inputFiles()
    assert files and {f.split("day=")[1][:10] for f in files} == {"2024-01-18", "2024-01-19", "2024-01-20"}
    assert logs.newest_days(spark, base, 21) == ["2024-01-20", "2024-01-19", "2024-01-18"]
    assert _ids(logs.recent_feedback(spark, base, 500)) == list(range(200))
    assert logs.log_days(spark, base)[-1] == logs.NO_DAY and len(logs.log_days(spark, base)) == 21
    assert logs.recent_feedback(spark, f"{base}/none").count() == 0


def test_compaction_keeps_every_record_once(spark, base, monkeypatch):
    for low in range(0, 40, 4):
        logs.append_log(_records(spark, low, low + 4), base)
    day = "2024-01-02"

    def files_read():
        return logs.read_log(spark, base, logs.FEEDBACK_SCHEMA, [day]).select(F.input_file_name()).distinct().count()

    before = files_read()
    assert logs.compact_day(spark, base, day) == 3 == before
    assert _ids(logs.read_log(spark, base, logs.FEEDBACK_SCHEMA)) == list(range(40))
    assert files_read() == 1
    logs.append_log(_records(spark, 10, 12), base)
    assert _ids(logs.read_log(spark, base, logs.FEEDBACK_SCHEMA, [day])) == sorted([*range(10, 20), 10, 11])
    assert logs.remove_replaced(spark, base, day) == 3 and logs.compact_day(spark, base, day) == 2
    assert _ids(logs.read_log(spark, base, logs.FEEDBACK_SCHEMA)) == sorted([*range(40), 10, 11])
    assert logs.compact_day(spark, base, day) == 0


def test_an_unfinished_compaction_does_not_count(spark, base, monkeypatch):
    for low in (0, 3, 6):
        logs.append_log(_records(spark, low, low + 3), base)
    day = "2024-01-01"

    def lost(*args):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(logs.CommitLog, "commit", lost)
        with pytest.raises(OSError):
            logs.compact_day(spark, base, day)
    assert _ids(logs.read_log(spark, base, logs.FEEDBACK_SCHEMA)) == list(range(9))
    commit = logs.CommitLog.commit

    def rival(self, *args):
        monkeypatch.setattr(logs.CommitLog, "commit", commit)
        assert logs.compact_day(spark, base, day) == 3
        return commit(self, *args)

    monkeypatch.setattr(logs.CommitLog, "commit", rival)
    assert logs.compact_day(spark, base, day) == 0
    assert _ids(logs.read_log(spark, base, logs.FEEDBACK_SCHEMA)) == list(range(9))
