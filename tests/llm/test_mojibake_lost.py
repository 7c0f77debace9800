"""Lost bytes: the readings that wildcards give compete on word counts."""

from frameloom.llm import mojibake

RU = "Человек снова берёт со стола синий стакан и ставит его на верхнюю полку"


def garbled(text):
    return text.encode().decode("cp1252", "replace")


def test_lost_bytes_are_read_through_the_lattice(spark):
    text = garbled(RU)
    assert mojibake.LOST in text
    df = spark.createDataFrame([*[(i, RU) for i in range(20)], (100, text)], "doc_id BIGINT, text STRING")
    got = {r["id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text").collect()}
    assert got == {100: RU}


def test_shape_lookup_is_the_fallback(spark):
    clean = "Die Schüssel fällt später über den Kühlschrank"
    df = spark.createDataFrame([*[(i, clean) for i in range(20)], (100, clean.encode("cp1252").decode("utf-8", "replace"))], "doc_id BIGINT, text STRING")
    got = {r["id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text").collect()}
    assert got == {100: clean}


def test_a_chunk_with_twelve_lost_bytes_is_restored(spark):
    word = "Сэсянаэссяэсянссэ"
    assert garbled(word).count(mojibake.LOST) >= 12
    near = "Яэсянаэссяэсянссэ"  # the same length and other letters, as common
    df = spark.createDataFrame([*[(i, f"{word} и {near}") for i in range(9)], (100, garbled(word))], "doc_id BIGINT, text STRING")
    got = {r["id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text").collect()}
    assert got == {100: word}


def test_lattice_path_against_all_fillings():
    """The path has the least cost among all ways to fill the lost bytes."""
    import itertools

    counts = {c: 2 * i + 1 for i, c in enumerate("сэяАНабв ÁÍÏ”“é")}
    model = mojibake.CharModel(counts)
    for text in ("сэ А", "Áé”", "бэН"):
        seen = garbled(text)
        at = [i for i, c in enumerate(seen) if c == mojibake.LOST]
        chars, holes = mojibake._table("cp1252")
        raw = [chars.get(ord(c), 0) for c in seen]
        costs = []
        for fill in itertools.product(sorted(holes), repeat=len(at)):
            for i, b in zip(at, fill, strict=True):
                raw[i] = b
            try:
                costs.append(sum(model.cost(c) for c in bytes(raw).decode()))
            except UnicodeDecodeError:
                continue
        got = sum(model.cost(c) for _, _, c, _ in mojibake.lattice_path(seen, "cp1252", model))
        assert abs(got - min(costs)) < 1e-9


def test_lattice_work_grows_with_the_length_only():
    model = mojibake.CharModel({c: 5 for c in "сэяАН"})
    path = mojibake.lattice_path(garbled("с" * 5000), "cp1252", model)
    assert len(path) == 5000 and all(lost for *_, lost in path)


def test_bytes_lost_in_the_first_of_two_wrong_readings(spark):
    text = garbled(garbled(RU).encode().decode("utf-8"))
    twice = garbled(RU).encode().decode("cp1252", "replace")
    df = spark.createDataFrame([*[(i, RU) for i in range(20)], (100, text), (101, twice)], "doc_id BIGINT, text STRING")
    got = {r["id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text").collect()}
    assert got[101] == RU
    assert set(got) == {100, 101}


def test_word_filter_never_misses():
    mine = mojibake.WordFilter(1 << 20)
    for i in range(500):
        mine.add(f"wörd{i}")
    assert all(f"wörd{i}" in mine for i in range(500))
    assert sum(f"öther{i}" in mine for i in range(500)) < 10
