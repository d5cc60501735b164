"""Objectives on a few cards: which queries each kind gives, and equal sets once."""

from kindred.operators.objectives import objectives

CARD = "seq long, name string, surname1 string, surname2 string, father string, mother string, spouse string, municipalities array<string>, provinces array<string>, sure boolean"


def test_objectives(spark):
    rows = [
        (1, "Ana Gil", "Gil", "", "", "", "", [], [], None), (2, "Ana Gil", "Gil", "", None, "", "", None, None, True), (3, " Ana Gil ", "Gil", "Mora", "", "", "Leo", ["", None], [" "], False),
        (4, "Blas Sáez de Torre", "Sáez de Torre", "Gil", "Juan Gil", "Eva Mora", "", ["Villa", "Aldea", "Villa"], ["Zamora"], True), (5, "Eva", "Gil", "Gil", "Juan", "", "", ["Villa"], ["Álava"], False), (6, None, "x", "x", "", "", "", ["Villa"], [], False),
        (7, "Blas Sáez de Torre", "Sáez de Torre", "Gil", "Juan Gil", "Eva Mora", "", ["Aldea", "Villa"], ["Zamora", "Zamora"], True),
    ]
    got = {r.seq: r for r in objectives(spark.createDataFrame(rows, CARD), ["alava"]).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].queries == ['"Ana Gil"'] and got[3].queries == ['"Ana Gil"', '"Ana Gil" "Leo"'] and got[3].name == "Ana Gil"
    q = set(got[4].queries)
    assert (got[4].municipality, got[4].province) == ("Aldea", "Zamora") and list(got[4].queries) == sorted(q, key=str.encode)
    assert {'"Blas Sáez de Torre" "Aldea"', '"Torre" "Villa"', '"Saez" "Villa"', '"Torre-Sáez" "Villa"', '"Gil" "Aldea"', '"Juan Gil" "Eva Mora" "matrimonio"', '"bautismo hijo de Juan Gil y Eva Mora" "Aldea"', '"Villa" "padrón"', '"Sáez de Torre" "Catastro de Ensenada" "Villa"', '"Villa" "Archivo Diocesano de Zamora"', '"Blas Sáez de Torre" "Zamora"'} <= q
    e = set(got[5].queries)
    # a province without the cadastre, one parent only, the second surname equal to the first
    assert not any("Ensenada" in x or "bautismo hijo" in x or "hijos de" in x for x in e) and {'"hijo de Juan" "Villa"', '"Gil" "Villa"', '"Villa" "bautismos"'} <= e and len(e) == 17
    assert objectives(spark.createDataFrame([], CARD), []).count() == 0
