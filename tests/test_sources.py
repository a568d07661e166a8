import gzip
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline import sinks
from weftline.operators import assertions, blocking, evaluate
from weftline.plans import build, report, warehouse
from weftline.sources import catalogue, dumps


def test_release_groups_from_tables(spark, tmp_path):
    rows = {
        "release_group": ["1\tg1\tOne\t10\t1\t\\N\t0\t\\N", "2\tg2\tTwo \"q\"\t11\t\\N\t\\N\t0\t\\N"],
        "artist_credit": ["10\tX & Y\t2\t1\t\\N\t0\tc1", "11\t\\N\t1\t1\t\\N\t0\tc2"],
        "release_group_primary_type": ["1\tAlbum\t\\N\t0\t\\N\tt1"],
        "l_release_group_url": ["1\t5\t1\t7\t0\t\\N\t0\t\t", "2\t5\t1\t8\t0\t\\N\t0\t\t", "3\t5\t2\t9\t0\t\\N\t0\t\t"],
        "url": ["7\tu1\thttps://www.discogs.com/master/42\t0\t\\N", "8\tu2\thttps://www.discogs.com/master/view/1\t0\t\\N", "9\tu3\thttp://discogs.com/master/77-x\t0\t\\N"],
        "link": ["5\t6" + "\t\\N" * 9],
        "link_type": ["6\t\\N\t0\tlt\trelease_group\turl\tdiscogs" + "\t\\N" * 9],
        "release": ["100\tr1\tOne\t10\t1" + "\t\\N" * 9, "101\tr2\tOne\t10\t1" + "\t\\N" * 9],
        "release_country": ["100\t1\t1999\t1\t1", "101\t1\t1990\t\\N\t\\N", "101\t2\tbad\t\\N\t\\N"],
        "release_unknown_country": ["100\t1985\t\\N\t\\N", "100\t0\t\\N\t\\N"],
    }
    for name, lines in rows.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    tables = {name: dumps.tsv(spark, str(tmp_path), name) for name in rows}
    got = {r["native_id"]: r for r in dumps.release_groups(tables).collect()}
    assert (got["g1"]["year"], got["g1"]["n_links"], got["g1"]["artist_credit"], got["g1"]["primary_type"]) == (1985, 1, "X & Y", "Album")
    assert got["g2"]["title"] == 'Two "q"' and got["g2"]["year"] is None and got["g2"]["artist_credit"] == ""
    assert {(r["a_id"], r["b_id"], r["link_type"]) for r in dumps.master_links(tables).collect()} == {("g1", "42", "discogs"), ("g2", "77", "discogs")}


def test_masters_from_xml(spark, tmp_path):
    xml = """<masters><master id="1"><main_release>5</main_release><artists><artist><name>A</name><join> &amp; </join></artist><artist><name>B</name><join>,</join></artist></artists><genres><genre>Rock</genre><genre>Pop</genre></genres><year>0</year><title>T</title></master>
<master id="2"><artists><artist><name>Solo</name><join></join></artist></artists><year>1999</year><title>U</title></master></masters>"""
    (tmp_path / "m.xml.gz").write_bytes(gzip.compress(xml.encode()))
    got = {r["native_id"]: r for r in dumps.masters(spark, str(tmp_path / "m.xml.gz")).collect()}
    assert (got["1"]["artist_credit"], got["1"]["year"], got["1"]["n_artists"], got["1"]["n_genres"], got["1"]["main_release"]) == ("A & B", None, 2, 2, 5)
    assert (got["2"]["artist_credit"], got["2"]["year"], got["2"]["n_genres"], got["2"]["main_release"]) == ("Solo", 1999, 0, None)


def test_items_and_exhibits(spark):
    claims = spark.createDataFrame([("q1", 1990, "album", "Z"), ("q1", 1985, "album", "A"), ("q1", None, "album", "A")], "item string, year int, class string, performer string")
    assert tuple(dumps.flattened_items(claims).first()) == ("q1", 1985, "album", "A; Z")
    rows = spark.createDataFrame([("a", "1", "m", "test"), ("a", "x", "m", "fit"), ("b", "2", "n", "test")], "a_id string, b_id string, method_version string, fold string")
    assert {r["problem"] for r in dumps.bad_exhibit_rows(rows, "m").collect()} == {"other method", "not the test fold", "malformed B id", "duplicate A"}


def test_adapters():
    with pytest.raises(KeyError):
        catalogue.adapter("none")
    for bad in (("documents_a", "a", print), ("x", "c", print)):
        with pytest.raises(ValueError):
            catalogue.register(*bad)


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("b", 0.1, True), ("a", None, None)], "a_id string, v1 double, labelled boolean")
    one, two = sinks.bundle_bytes(frame, ("a_id", "v1", "labelled"), "a_id"), sinks.bundle_bytes(frame.orderBy("a_id"), ("a_id", "v1", "labelled"), "a_id")
    assert one == two and gzip.decompress(one).decode() == "a_id,v1,labelled\na,,\nb,0.1,true\n"
    first = sinks.write_table(frame, str(tmp_path / "t"))
    assert first["rows"] == 2 and first["content"] == sinks.write_table(frame.orderBy("v1"), str(tmp_path / "u"))["content"]
    assert sinks.canonical({"b": 1, "a": "é"}) == '{\n "a": "\\u00e9",\n "b": 1\n}\n'
    with pytest.raises(ValueError):
        sinks.canonical({"x": float("nan")})
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}}}
    assert sinks.invalid({"a": 1}, schema) == [] and len(sinks.invalid({"a": True, "b": 1}, schema)) == 2
    assert sinks.resolve({"a": {"b": [0, {"x.y": 5}]}}, 'a.b[1]["x.y"]') == 5
    assert sinks.forbidden_keys({"a": [{"secret": 1}]}, frozenset(["secret"])) == ["$.a[0].secret"]


LEVEL = {"n": 4, "ece": 0.1, "brier": 0.2, "bins": [{"lower": i / 10, "upper": (i + 1) / 10, "n": 1, "mean_probability": 0.5, "observed_rate": 0.5} for i in range(10)]}


def artifacts(root):
    prf = {"accepted": 4, "correct": 3, "precision": 0.75, "recall_labelled": 0.5, "f1": 0.6}
    metrics = {"test_a": 10, "labelled_a": 6, "labelled_a_reachable": 5, "pair_completeness_test": 0.8, "at_auto_accept": prf, "at_auto_accept_or_review": prf, "recall_overall": 0.5, "coverage": 0.4, "coverage_all_folds": 0.4, "unverified_accepts": {"count": 1, "share_of_accepts": 0.2}, "tier_shares": {"auto_accept": 0.5, "review": 0.25, "reject": 0.25}, "ambiguity_rule": {"decisions_moved_to_review": 1, "review_queue": 2}, "calibration": {"decision_level": LEVEL, "pair_level": LEVEL}}
    fold = {"a_records": 1, "labelled_a_records": 1, "candidate_pairs": 2, "decisions": 1}
    for m in ("exact_v1", "rules_v1"):
        sinks.write_json({"method_version": m, "generated_at_utc": "2026-01-01T00:00:00Z", "fold_counts": {"fit": fold, "calibrate": fold, "test": fold}, "metrics": metrics}, f"{root}/eval_{m}.json")
        sinks.write_json({"method_version": m, "feature_version": "f", "thresholds": {"auto_accept_min": 0.95, "review_min": 0.5, "ambiguity_gap": 0.1}}, f"{root}/methods/{m}.json")
    sinks.write_json({"run_id": "r", "created_at_utc": "2026-01-01T00:00:00Z", "sources": [{"name": "a", "records": 3, "sha256": "x"}]}, f"{root}/manifest.json")
    point = {"threshold": 0.95, "accepts": 4, "queue_floor": 1, "queue_ambiguity": 1, "review_queue": 2, "precision_labelled": 0.75, "expected_false_accepts": 1.0, "total_cost": {"1": 3.0, "5": 7.0, "20": 22.0}}
    sinks.write_json({"methods": {"rules_v1": {"review_min": 0.5, "chosen_accept_threshold": 0.95, "points": [point], "review_floor_sweep": {"points": [{"floor": 0.5, "queue_floor": 1, "queue_ambiguity": 1, "queue_total": 2, "queue_share_of_test_a": 0.2, "recall_with_review": 0.9}]}}}}, f"{root}/review_sensitivity.json")
    sinks.write_json({"candidate_cap_per_a": 200, "union_pairs": 9, "candidate_pairs_after_cap": 8, "per_key_pairs": {"k_title3": 5, "k_artist_year": 6}, "pair_completeness": {"union": 0.9, "after_cap": 0.8, "per_key": {"k_title3": 0.7}}}, f"{root}/blocking_report.json")
    sinks.write_json({"a": [{"name": "grain_unique", "passed": True, "violations": 0}], "b": []}, f"{root}/contracts.json")
    sinks.write_json({"bounds": {"fit": [0, 60], "test": [80, 100]}, "folds": {"fit": {"a_records": 1, "truth_pairs": 1, "candidate_pairs": 1}, "test": {"a_records": 2, "truth_pairs": 1, "candidate_pairs": 1}}}, f"{root}/split.json")
    sinks.write_json({"cases": [{"case_id": "c1", "a_id": "a1", "reason_codes": ["x", "y"], "selection_rank": 1}]}, f"{root}/lab/case_selection.json")
    evidence = [{"method_version": "exact_v1", "exported": True, "b_id": "9", "score": 1.0, "probability": 1.0, "tier": "auto_accept", "top2_gap": None, "gap_state": "single_candidate", "block_keys": ["k1", "k2"]}, {"method_version": "rules_v1", "exported": False, "reason": "rejected"}]
    sinks.write_json({"cases": [{"case_id": "c1", "comparison": {"agreement_class": "single_method_exported"}, "evidence": evidence}]}, f"{root}/lab/cases.json")
    head, row = "a_id,b_id,method_version,feature_version,score,probability,tier,block_keys,top2_gap,fold,run_id,decided_at_utc", "a1,{},exact_v1,f,1.0,{},auto_accept,k1|k2,,test,r,2026-01-01T00:00:00Z"
    (root / "mapping").mkdir()
    (root / "mapping/mapping_exact_v1.test.csv.gz").write_bytes(gzip.compress("\n".join([head, row.format(9, 1.0), row.format(8, 0.9)]).encode()))


def test_warehouse(spark, tmp_path):
    artifacts(tmp_path)
    made = warehouse.build(spark, str(tmp_path))
    rows = {name: df.collect() for name, df in made.items()}
    wide = rows["fct_eval_metrics"]
    assert len(wide) == 2 and wide[0]["accepted"] == 4 and wide[0]["tier_share_review"] == 0.25
    assert len(rows["slv_eval_metrics"]) == 52 and len(rows["fct_calibration"]) == 40 and len(rows["slv_eval_folds"]) == 6
    assert [r["b_id"] for r in rows["fct_mapping"]] == ["9"] and len(rows["brz_mapping"]) == 2
    assert {r["cost_ratio"]: r["total_cost_recomputed"] for r in rows["fct_review_queue"]} == {1: 3.0, 5: 7.0, 20: 22.0}
    assert {r["block_key"]: r["completeness"] for r in rows["fct_blocking"]} == {"k_title3": 0.7, "k_artist_year": None}
    assert {r["fold"]: r["bucket_from"] for r in rows["brz_split"]} == {"fit": 0, "test": 80}
    assert rows["fct_lab_case_comparison"][0]["agreement_class"] == "single_method_exported"
    assert {r["method_version"]: r["block_keys"] for r in rows["brz_lab_cases"]} == {"exact_v1": "k1|k2", "rules_v1": None}
    bundle, mart = made["brz_lab_cases"], made["fct_lab_case_evidence"]
    assert assertions.unequal_evidence(bundle, mart).count() == 0
    assert assertions.unequal_evidence(bundle.filter("exported"), mart).count() == 1
    metrics = tuple(warehouse.METRIC_PATHS)
    assert assertions.unreconciled(made["slv_eval_metrics"], made["fct_eval_metrics"], metrics).count() == 0
    assert assertions.unreconciled(made["slv_eval_metrics"].filter("metric <> 'ece'"), made["fct_eval_metrics"], metrics).count() == 2
    assert assertions.missing_baselines(made["brz_eval_artifacts"], made["fct_eval_metrics"]).count() == 0
    assert assertions.not_whole(made["slv_eval_metrics"], warehouse.COUNTS).count() == 0
    assert assertions.recall_above_completeness(made["fct_eval_metrics"]).count() == assertions.shares_not_one(made["fct_eval_metrics"]).count() == assertions.wrong_costs(made["fct_review_queue"]).count() == 0
    assert assertions.shares_outside({"m": (made["fct_eval_metrics"], ("coverage", "test_a"))}).count() == 2
    assert assertions.relationship(made["fct_mapping"], "method_version", made["dim_method_version"], "method_version").count() == 0
    assert sinks.export({"dim_source": made["dim_source"]}, str(tmp_path / "out")) == {"dim_source": 1}


def test_models_are_tables_of_their_layers(spark, tmp_path):
    artifacts(tmp_path)
    made = warehouse.build(spark, str(tmp_path), ("fct_mapping", "dim_source"))
    names = warehouse.materialise(spark, made)
    assert set(names) == {"bronze.brz_mapping", "silver.slv_mapping", "gold.fct_mapping", "bronze.brz_manifest_sources", "gold.dim_source"}
    assert [r["b_id"] for r in spark.table("gold.fct_mapping").collect()] == ["9"] and {d.name for d in spark.catalog.listDatabases()} >= {"bronze", "silver", "gold"}
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_warehouse_without_artifacts(spark, tmp_path):
    made = warehouse.build(spark, str(tmp_path))
    assert all(df.count() == 0 for df in made.values())


def test_build(spark, tmp_path):
    results = build.run(spark, "/root/testdata/sf0.01", str(tmp_path), learned=False)
    assert set(results) == {"exact_v1", "rules_v1"}
    read = lambda name: json.loads((tmp_path / name).read_text())
    manifest, blocked, split = read("manifest.json"), read("blocking_report.json"), read("split.json")
    assert manifest["rows"] == blocked["candidate_pairs_after_cap"] == sum(f["candidate_pairs"] for f in split["folds"].values()) > 0
    assert set(manifest["runtime"]) == {"load", "truth", "sample", "contracts", "truth_audit", "blocking", "split", "features", "exact_v1", "rules_v1"}
    assert read("truth_audit.json")["truth_in_sample"] > 0 and all(c["name"] for c in read("contracts.json")["a"])
    assert spark.read.parquet(str(tmp_path / "features")).filter(F.col("fold") == "test").count() == split["folds"]["test"]["candidate_pairs"]
    # what it publishes is what the warehouse reads
    made = warehouse.build(spark, str(tmp_path))
    wide = {r["method_version"]: r for r in made["fct_eval_metrics"].collect()}
    assert wide["rules_v1"]["coverage_all_folds"] == results["rules_v1"]["coverage_all_folds"] and wide["rules_v1"]["ece"] is not None
    assert made["fct_review_queue"].count() == 2 * 50 * 3 and made["slv_eval_folds"].count() == 6 and made["dim_source"].count() == 2
    assert made["fct_mapping"].count() == sum(read(f"methods/{m}.json")["mapping"]["test_rows"] for m in results)
    assert {r["check_name"] for r in made["brz_contracts"].collect()} >= {"grain_unique", "year_range"}
    # values of the run are read again, others are computed anew, or not to be had
    features = spark.read.parquet(str(tmp_path / "features"))
    for run_id, method, there in ((manifest["run_id"], "rules_v1", True), ("other", "rules_v1", True), ("other", "learned_v1", False)):
        values = build.decision_values(spark, str(tmp_path), run_id, method, features)
        assert (values is not None) == there and (not there or values.count() == manifest["rows"])
    again = build.run(spark, "/root/testdata/sf0.01", str(tmp_path / "again"), learned=False)
    assert evaluate.unequal(again, results) == [] and not [d for d in report.differences(str(tmp_path), str(tmp_path / "again")) if "again/" not in d]
    with pytest.raises(blocking.TooManyPairs):
        build.run(spark, "/root/testdata/sf0.001", str(tmp_path / "gated"), learned=False, gate=1)
    assert not (tmp_path / "gated/features").exists()


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["a_id", "b_id", "tier", "top2_gap"] and frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
