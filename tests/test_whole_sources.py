from latticework.plans import batch_queries as Q


def test_every_file_is_looked_up(spark, tmp_path):
    spark.sql("select named_struct('chunk_id', c) as attributes from values ('chart_1_01'), ('chart_1_02') t(c)").write.parquet(f"{tmp_path}/relation.parquet")
    spark.sql("select 'e' as id, array('chart_1_01', 'chart_1_02') as source").write.parquet(f"{tmp_path}/entity.parquet")
    assert sorted(tuple(r) for r in Q.QUERIES["proj22_entities_of_sources"](spark, str(tmp_path)).collect()) == [("chart_1_01", "e"), ("chart_1_02", "e")]
