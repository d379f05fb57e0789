"""Labelled findings that the secret scan's forest is trained on, generated from patterns of real ones."""

from __future__ import annotations

import random
import string
import uuid

# Words in names that credentials are assigned to.
CREDENTIAL_WORDS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth", "bearer", "key")

# Words beside strings that look random but are not secret.
HARMLESS_WORDS = ("sha", "md", "commit", "checksum", "digest", "revision", "uuid", "guid", "hash", "etag", "integrity", "isbn", "serial", "order", "invoice", "version",
                  "build", "example", "placeholder", "sample", "dummy", "fixture", "figure", "section", "phone", "tracking", "doi", "file", "image", "path", "url", "id")

# Common words that names, placeholders and paths are made of.
DICTIONARY = ("able", "about", "access", "account", "action", "address", "admin", "after", "again", "agent", "also", "area", "array", "asset", "auth", "back", "base", "batch", "before", "block",
              "body", "book", "build", "button", "cache", "call", "case", "change", "check", "class", "clean", "client", "cloud", "code", "common", "config", "connect", "content", "control", "count",
              "create", "credential", "current", "data", "date", "default", "delete", "detail", "device", "dist", "document", "download", "email", "enter", "entry", "error", "event", "example", "export", "field",
              "file", "filter", "find", "first", "folder", "form", "format", "from", "function", "generate", "group", "hand", "handler", "have", "head", "help", "here", "home", "host", "house",
              "html", "image", "import", "index", "info", "input", "insert", "item", "jpeg", "json", "lang", "last", "layer", "length", "level", "library", "light", "line", "link", "list",
              "load", "local", "login", "main", "make", "manager", "match", "media", "message", "method", "model", "module", "name", "network", "node", "number", "object", "open", "option", "order",
              "output", "page", "param", "parent", "part", "pass", "password", "path", "place", "plugin", "point", "process", "product", "project", "public", "query", "read", "record", "remote", "replace",
              "report", "request", "resource", "response", "result", "return", "role", "root", "route", "sample", "schema", "script", "search", "secret", "section", "select", "server", "service", "session")

_HEX, _ALNUM, _WORDY = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_lowercase
_SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sch", "ung", "keit", "eau", "tre", "ment", "que", "ado", "mente")


def _pick(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _prose(r: random.Random, n: int) -> str:
    return " ".join(_word(r) + r.choice(["", "", "", ",", "."]) for _ in range(n))


# What stands for a secret in documentation.
STAND_INS = ("your", "xxx", "changeme", "change-me", "replace", "placeholder", "example", "dummy", "insert", "redacted", "todo", "enter", "***", "...", "<", "${", "{{", "%(", "$(", "env", "getenv", "vault", "forgot", "must")

_PASSWORD_NAMES = ("password", "passwd", "pwd", "passphrase", "secret", "db_password", "PASSWORD", "adminPassword", "smtp_password", "MYSQL_ROOT_PASSWORD", "user_pwd")
_USERS = ("admin", "root", "deploy", "svc", "app", "backup", "reader", "postgres", "guest", "ci")
_LEET = str.maketrans("aeios", "43105")


def _said(r: random.Random) -> str:
    """Something that can be pronounced, from consonants and vowels in turn."""
    return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))


def _chosen(r: random.Random) -> str:
    """A password as people choose them: words, digits, a sign."""
    word = lambda: r.choice([r.choice(DICTIONARY), _said(r)])
    value = r.choice([
        lambda: word() + _pick(r, string.digits, r.randint(1, 4)) + r.choice(["", "!", "#", "$", "@"]), lambda: (word() + r.choice(string.digits)) * 2, lambda: "".join(word() for _ in range(r.randint(2, 4))),
        lambda: word().translate(_LEET).capitalize() + word().capitalize() + r.choice(["", "!", "99"]), lambda: r.choice("-_.").join(word() for _ in range(4)), lambda: word().capitalize() + r.choice("!@#") + _pick(r, string.digits, 4)])()
    return value if len(value) >= 8 else value + _pick(r, string.digits + string.ascii_lowercase, 9 - len(value))


def _secret_elsewhere(r: random.Random) -> tuple[str, str, str]:
    """Chosen passwords, passwords in addresses, tokens of letters: (what stands before, the secret, what stands behind)"""
    kind = r.randrange(4)
    if kind < 2:
        quote = r.choice(['"', '"', "'"])
        return r.choice(["", '"', "export ", "--"]) + r.choice(_PASSWORD_NAMES) + r.choice([" = ", "=", ": ", ":", " => "]) + quote, _chosen(r), ""
    if kind == 2:
        value = r.choice([_chosen(r), _pick(r, _ALNUM, r.randint(10, 24))])
        return f"{r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb+srv', 'ftp'])}://{r.choice(_USERS)}:", value, f"@{_said(r)}.example.net{r.choice(['', ':5432', '/db', ':27017/app'])}"
    return r.choice(["Authorization: Bearer ", "bearer ", "-H 'Authorization: Basic ", "Authorization: token "]), _pick(r, string.ascii_letters, r.randint(20, 48)), r.choice(["", "", "'", '"'])


def _harmless_elsewhere(r: random.Random) -> tuple[str, str, str]:
    """The same places with something else in them."""
    kind = r.randrange(5)
    name = r.choice([*_PASSWORD_NAMES, "token", "api_key", "API_KEY", "auth"])
    if kind == 0:
        about = [r.choice(STAND_INS[:12]), *(r.choice(DICTIONARY) for _ in range(r.randint(1, 3))), r.choice(["password", "here", "key", "token", "it"])]
        return name + r.choice([" = ", ": ", "="]) + r.choice(['"', "'"]), r.choice([" ", "-", "_"]).join(about), ""
    if kind == 1:
        of = r.choice(["os.environ[", "process.env.", "${", "{{ ", "getenv(", "$(", "config.", "settings.", "vault:", "<", "%("]) + r.choice(["DB_", "APP_", "", "user_"]) + name
        return name + r.choice([" = ", ": ", "="]) + r.choice(["", "", '"']), of + r.choice(["]", "}", ")", " }}", ">", ""]), ""
    if kind == 2:
        return name + r.choice([": ", " = "]) + r.choice(['"', "'"]), " ".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 9))), ""
    if kind == 3:
        return r.choice(["password: ", "token: ", "secret: ", "the key: ", "Passwort: ", "auth: "]), r.choice(["required", "optional", "mandatory", "disabled", "encrypted", "expired in", "see below", _said(r) + _said(r), r.choice(DICTIONARY) + "ation"]).ljust(8, "s"), ""
    return r.choice(["postgres://", "https://"]) + r.choice(["user", "username", "admin"]) + ":", r.choice(["password", "${PASSWORD}", "<password>", "xxxxxxxx", "********", "{{db_password}}", "your_password", "$DB_PASSWORD"]), f"@{_said(r)}.example.net/db"


def _secret(r: random.Random) -> tuple[str, str]:
    """(what stands before, the secret)"""
    name = r.choice(["token", "secret", "api_key", "apikey", "API_KEY", "access_token", "auth_token", "client_secret", "SECRET_KEY", "password", "passwd", "db_password", "private_key", "aws_secret_access_key", "key", "AuthToken", "bearer"])
    assign = r.choice([" = ", "=", ": ", ":", " := ", " => "])
    quote = r.choice(['"', '"', "'", ""])
    kind = r.randrange(10)
    if kind < 3:
        value = _pick(r, _HEX, r.choice([32, 40, 40, 48, 64]))
    elif kind < 5:
        value = _pick(r, _ALNUM, r.randint(20, 64))
    elif kind < 6:
        value = _pick(r, _ALNUM + "+/", r.choice([40, 43, 86])) + r.choice(["", "=", "=="])
    elif kind < 7:
        value = _pick(r, _ALNUM + "!@#$%^&*_-", r.randint(10, 20))
    else:
        value = r.choice([
            lambda: "AKIA" + _pick(r, string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + _pick(r, _ALNUM, 36), lambda: "xoxb-" + _pick(r, string.digits, 12) + "-" + _pick(r, _ALNUM, 24),
            lambda: "sk_live_" + _pick(r, _ALNUM, 24), lambda: "AIza" + _pick(r, _ALNUM + "_-", 35), lambda: "eyJ" + _pick(r, _ALNUM, 33) + "." + "eyJ" + _pick(r, _ALNUM, 60) + "." + _pick(r, _ALNUM + "_-", 43),
            lambda: "glpat-" + _pick(r, _ALNUM, 20), lambda: "sk-" + _pick(r, _ALNUM, 48)])()
        if r.random() < 0.4:
            return r.choice(["", '"', "(", "Authorization Bearer "]), value
    return name + assign + quote, value


def _harmless(r: random.Random) -> tuple[str, str]:
    kind = r.randrange(12)
    if kind == 0:
        return r.choice(["commit ", "sha256: ", "md5 = ", "checksum: ", "digest ", "revision ", "etag: \"", "hash ", "integrity sha256-", "sha1 = \""]), _pick(r, _HEX, r.choice([32, 40, 64]))
    if kind == 1:
        return r.choice(["uuid: ", "id = ", "guid ", "", "request_id=", "token_id: "]), str(uuid.UUID(int=r.getrandbits(128)))
    if kind == 2:
        return r.choice(["api_key = \"", "token: ", "password=", "secret = '"]), r.choice(["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "<your-token-here>", "changeme_example", "REPLACE_WITH_SECRET", "placeholder123456789", "example-password-1", "insert_token_here_1", "0000000000000000", "1234567890abcdef1234"])
    if kind == 3:
        return r.choice(["", "see ", "file ", "from "]), "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)) + r.choice([".html", ".py", ".jpeg", ""])
    if kind == 4:
        return r.choice(["https://", "http://", "www."]), f"{_word(r)}{r.randint(1, 99)}.example.org/" + "/".join(_word(r) for _ in range(3)) + str(r.randint(1, 9999))
    if kind == 5:
        return r.choice(["", "token = ", "key: ", "auth = "]), r.choice(["get_", "load_", "make_", "config."]) + "_".join(r.choice(DICTIONARY) for _ in range(3)) + str(r.randint(1, 9)) + r.choice(["()", "", "(self)"])
    if kind == 6:
        return r.choice(["", "card ", "order ", "invoice ", "serial ", "phone ", "key ", "tracking "]), _pick(r, string.digits, r.randint(16, 22))
    if kind == 7:
        return r.choice(["", "build ", "version "]), f"{r.choice(DICTIONARY)}-{r.choice(DICTIONARY)}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{r.choice(['beta', 'final', 'linux'])}{r.randint(1, 9)}"
    if kind == 8:
        return r.choice(["", " "]), "".join(_word(r) for _ in range(5)) + r.choice(["1", "2", "-3", "_4", ".5"])
    if kind == 9:
        return r.choice(["mail ", "", "to "]), f"{_word(r)}.{_word(r)}{r.randint(1, 999)}.mail{r.randint(1, 9)}.example.com"
    if kind == 10:
        return r.choice(["", "at ", "on "]), f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}"
    return r.choice(["key = ", "password: ", "token: ", "auth: ", "secret: "]), _word(r) + _word(r) + _word(r) + _word(r)


def generated_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """``n`` findings (text, start, end, label), the same for the same seed; half of them are secrets."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        label = i % 2
        if r.random() < 0.3:
            before, value, behind = _secret_elsewhere(r) if label else _harmless_elsewhere(r)
        else:
            before, value, behind = *(_secret(r) if label else _harmless(r)), ""
        opener = before[-1:] if before[-1:] in "\"'" else ""
        text = _prose(r, r.randint(0, 8)) + r.choice([" ", "\n", " "]) + before
        start = len(text)
        text += value + opener + behind + r.choice(["", " ", "\n", "### ", "$$$ ", ", "]) + _prose(r, r.randint(0, 6))
        out.append((text, start, start + len(value), label))
    return out
