import pytest

from mosaica import Session
from mosaica.functions import FUNCTIONS

CASES = {
    "string::concat('a', null, 1)": "a1", "string::contains('abc', 'b')": True, "string::ends_with('abc', 'c')": True, "string::starts_with('abc', 'b')": False,
    "string::join('-', 'a', 'b')": "a-b", "string::join('-', ['a', 'b'])": "a-b", "string::len('héé')": 3, "string::length(null)": 0, "string::lowercase('AB')": "ab", "string::uppercase('ab')": "AB",
    "string::repeat('ab', 2)": "abab", "string::replace('a.b', '.', '-')": "a-b", "string::reverse('abc')": "cba", "string::slice('abcdef', 1, 3)": "bcd", "string::slice('abcdef', -2)": "ef",
    "string::split('a,b,,', ',')": ["a", "b", "", ""], "string::trim('\t a ')": "a", "string::words(' a  b ')": ["a", "b"], "string::matches('abc', 'a.c')": True, "string::matches('xabc', 'a.c')": False,
    "string::slug('Olá, Mundo!')": "ola-mundo", "string::capitalize('olá mundo')": "Olá mundo", "string::pad_start('5', 3, '0')": "005", "string::pad_end('long', 2)": "long",
    "math::abs(-3)": 3, "math::sign(-2.5)": -1, "math::ceil(1.2)": 2, "math::floor(-1.2)": -2, "math::round(-2.5)": -2, "math::round(2.5)": 3, "math::fixed(2.345, 2)": 2.35, "math::fixed(-2.345, 2)": -2.35,
    "math::sqrt(9)": 3.0, "math::pow(2, 3)": 8.0, "math::log(8, 2)": pytest.approx(3.0), "math::log10(1000)": pytest.approx(3.0), "math::log2(8)": 3.0, "math::ln(1)": 0.0, "math::exp(0)": 1.0, "math::clamp(15, 0, 10)": 10.0,
    "math::min(3, 1, 2)": 1, "math::max([3, 1, 2])": 3, "math::sum([1, 2, 3])": 6, "math::sum([])": 0, "math::mean([1, 2])": 1.5, "math::mean([])": None, "math::median([3, 1, 2, 4])": 2.5, "math::product([2, 3])": 6.0,
    "array::add([1, 2], 2)": [1, 2], "array::add([1], 2)": [1, 2], "array::append([1], 1)": [1, 1], "array::push([1], 2)": [1, 2], "array::prepend([1], 0)": [0, 1], "array::all([1, 0])": False, "array::any([0, 1])": True,
    "array::at([1, 2, 3], -1)": 3, "array::concat([1], [2], [3])": [1, 2, 3], "array::complement([1, 2, 2, 3], [3])": [1, 2, 2], "array::difference([1, 2, 2], [2, 3])": [1, 3], "array::distinct([1, 1, 2])": [1, 2],
    "array::find_index([5, 6], 6)": 1, "array::find_index([5], 7)": -1, "array::first([1, 2])": 1, "array::last([1, 2])": 2, "array::first([])": None, "array::flatten([[1], [2, 3]])": [1, 2, 3], "array::insert([1, 3], 2, 1)": [1, 2, 3],
    "array::intersect([1, 2, 2], [2])": [2], "array::join('-', [1, 2])": "1-2", "array::len([1, 2])": 2, "array::length(null)": 0, "array::max([1, 5])": 5, "array::min(['b', 'a'])": "a", "array::pop([1, 2])": [1], "array::remove([1, 2, 3], 1)": [1, 3],
    "array::reverse([1, 2])": [2, 1], "array::slice([1, 2, 3], 1)": [2, 3], "array::slice([1, 2, 3], -2, 1)": [2], "array::sort([2, 1])": [1, 2], "array::sort::desc([1, 2])": [2, 1], "array::sort::asc([2, 1])": [1, 2], "array::union([1, 2], [2, 3])": [1, 2, 3],
    "object::keys({a: 1, b: 2})": ["a", "b"], "object::values({a: 1, b: 2})": [1, 2], "object::len({a: 1})": 1, "object::length({})": 0, "object::entries({a: 'x'})": [["a", "x"]], "object::from_entries([['a', 'x']])": {"a": "x"},
    "type::int('12')": 12, "type::int('x')": 0, "type::float('1.5')": 1.5, "type::number('2')": 2.0, "type::bool('true')": True, "type::bool(0)": False, "type::string(5)": "5", "type::datetime('bad')": None, "type::table('t')": "t", "type::record('t', 1)": "t:1", "type::array(1)": [1],
    "type::is::array([1])": True, "type::is::bool(true)": True, "type::is::datetime(d'2024-01-01T00:00:00Z')": True, "type::is::none(null)": True, "type::is::null(1)": False, "type::is::number('1')": False, "type::is::object({a: 1})": True, "type::is::record(person:1)": True, "type::is::string('a')": True,
    "record::id(person:1)": "1", "meta::id('person:ana')": "ana", "record::table(person:1)": "person", "record::tb('x:1')": "x", "meta::tb('x:1')": "x", "record::exists(person:1)": True,
    "time::year(d'2024-03-04T05:06:07Z')": 2024, "time::month(d'2024-03-04T05:06:07Z')": 3, "time::day(d'2024-03-04T05:06:07Z')": 4, "time::hour(d'2024-03-04T05:06:07Z')": 5, "time::minute(d'2024-03-04T05:06:07Z')": 6, "time::second(d'2024-03-04T05:06:07Z')": 7,
    "time::yday(d'2024-03-04T05:06:07Z')": 64, "time::wday(d'2024-03-04T05:06:07Z')": 1, "time::unix(d'1970-01-01T00:01:00Z')": 60, "time::millis(d'1970-01-01T00:00:01Z')": 1000, "time::unix(time::from::unix(5))": 5, "time::millis(time::from::millis(1500))": 1500,
    "crypto::md5('a')": "0cc175b9c0f1b6a831c399e269772661", "string::len(crypto::sha1('a'))": 40, "string::len(crypto::sha256('a'))": 64, "string::len(crypto::sha512('a'))": 128, "encoding::base64::encode('olá')": "b2zDoQ==", "encoding::base64::decode('b2zDoQ==')": "olá",
    "value::coalesce(null, 2, 3)": 2, "value::default(null, 'x')": "x", "vector::distance::euclidean([0, 0], [3, 4])": 5.0, "vector::distance::manhattan([0, 0], [3, 4])": 7.0, "vector::similarity::cosine([1, 0], [2, 0])": 1.0, "vector::distance::cosine([1, 0], [-1, 0])": 2.0, "vector::similarity::cosine([0, 0], [1, 1])": 0.0, "vector::distance::euclidean([1], [1, 2])": None,
    "geo::hash::encode(geometry::point(-5.6, 42.6), 5)": "ezs42", "geo::hash(geometry::point(-5.6, 42.6), 3)": "ezs", "geo::hash::encode(geo::hash::decode('ezs42'), 5)": "ezs42", "string::len(type::decimal('1.5'))": 12, "time::year(now()) > 2000": True, "time::now() = now()": True, "math::pi": pytest.approx(3.14159265), "math::tau": pytest.approx(6.2831853),
}


@pytest.fixture(scope="module")
def values(spark):
    s = Session(spark)
    texts = list(CASES)
    got = {}
    for i in range(0, len(texts), 40):
        some = texts[i : i + 40]
        row = s.query("SELECT " + ", ".join(f"{{v: {t}}} AS c{k}" for k, t in enumerate(some)) + " FROM [{one: 1}]").first()
        got |= {t: row[k]["v"] for k, t in enumerate(some)}
    return got


@pytest.mark.parametrize("text", CASES)
def test_value(values, text):
    v = values[text]
    assert (list(v) if isinstance(v, list) else v) == CASES[text]


def test_random(spark):
    s = Session(spark)
    for text, ok in {"rand()": lambda v: 0 <= v < 1, "rand::int(1, 6)": lambda v: 1 <= v <= 6, "rand::float(2, 3)": lambda v: 2 <= v < 3, "rand::string(9)": lambda v: len(v) == 9, "rand::uuid()": lambda v: len(v) == 36, "rand::bool()": lambda v: isinstance(v, bool), "rand::enum('a', 'b')": lambda v: v in "ab", "array::len(array::shuffle([1, 2, 3]))": lambda v: v == 3}.items():
        assert ok(s.execute(f"RETURN {text}")), text


def test_every_function_has_a_case():
    """Each registered function is called by some test."""
    import pathlib

    text = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("test_*.py")) + pathlib.Path(__file__).parent.parent.joinpath("mosaica/queries.py").read_text()
    missing = [name for name in FUNCTIONS if f"{name}(" not in text]
    assert missing == []


def test_unknown_function_is_refused(spark):
    with pytest.raises(ValueError):
        Session(spark).execute("RETURN no::such(1)")
