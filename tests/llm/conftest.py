import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EN = "the and of to in that it was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()


def sentence(words, seed, n=60):
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, nulls, empty and short texts, a repeated row and a null id."""
    rows = []
    for i in range(40):
        rows.append((i, sentence(EN, i), "en", f"s{i % 3}", 0))
        rows.append((100 + i, sentence(DE, i), "de", f"s{i % 4}", 0))
    base = rows[0][1].split()
    rows += [(200, rows[0][1], "en", "s0", 0), (201, rows[0][1].upper(), "en", "s0", 0), (202, " ".join([*base[:-1], "changed."]), "en", "s1", 0)]
    rows += [(300, None, None, None, 0), (301, "", "en", "s1", 0), (302, "the of", "en", "s1", 0), (303, "The  OF", "en", None, 0), (304, "12345 !!", "en", "s2", 0), (304, "12345 !!", "en", "s2", 0), (None, "the and of to in that", "en", "s1", 0)]
    rows.append((400, "the token = \"AbCdEf0123456789xyz\" and 0123456789abcdef0123 Released under the MIT License. " * 30, "en", "s2", 0))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
