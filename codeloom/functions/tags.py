"""Framework and security tags of files and symbols, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tag_symbol

#: Client entry points, calls that are unsafe or start processes, attributes and their tags.
CLIENT_ENTRIES = "getFirestore getAuth getStorage getDatabase getFunctions getAnalytics getMessaging getRemoteConfig getPerformance getAppCheck".split()
UNSAFE_CALLS = "strcpy strncpy strcat strncat sprintf vsprintf gets scanf sscanf memcpy memmove".split()
EXEC_CALLS = "system popen execl execlp execle execv execvp execve".split()
ATTRIBUTES = {"Authorize": "[CS_AUTHORIZE]", "AllowAnonymous": "[CS_ALLOW_ANON]", "HttpPost": "[CS_HTTP_MUTATE]", "HttpPut": "[CS_HTTP_MUTATE]", "HttpDelete": "[CS_HTTP_MUTATE]", "HttpGet": "[CS_HTTP_READ]", "HttpPatch": "[CS_HTTP_MUTATE]", "ValidateAntiForgeryToken": "[CS_CSRF_GUARD]"}
MUTATION = r"\b(?:setDoc|addDoc|updateDoc|deleteDoc|writeBatch|runTransaction)\b|\.(?:set|add|update|delete)\s*\("


def _tags(*rules: tuple[str, Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(hit, F.lit(tag)) for tag, hit in rules))))


def script_file(path: Column, text: Column) -> Column:
    """Tags of a TS/JS file: a directive in its first ten lines, its place in the app folder, a store."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n")
    client = head.rlike(r"""(?m)^\s*['"]use client['"]""")
    server = head.rlike(r"""(?m)^\s*['"]use server['"]""") & ~client
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    page = p.rlike(r"/app/.*/page\.tsx?$")
    store = text.rlike(r"""(?m)^\s*import\b[^;\n]*['"][^'"\n]*zustand""") & text.rlike(r"(?<![\w.$])create\s*(?:<[^>]*>)?\s*\(")
    return _tags(("[USE_CLIENT]", client), ("[USE_SERVER]", server), ("[NEXT_PAGE]", page), ("[NEXT_LAYOUT]", ~page & p.rlike(r"/app/.*/layout\.tsx?$")), ("[ZUSTAND_STORE]", store))


def script_symbol(path: Column, kind: Column, name: Column, text: Column, file_tags: Column) -> Column:
    """Tags of a TS/JS symbol, then its categories."""
    calls = lambda names: text.rlike(r"(?<![\w.$])(?:" + "|".join(names) + r")\s*\(")
    plain = kind.isin("function", "arrow_function")
    action = F.array_contains(file_tags, "[USE_SERVER]") & (plain | (kind == "method")) & F.substring(text, 1, 200).rlike(r"\bexport\b")
    own = _tags(
        ("[REACT_COMPONENT]", path.rlike(r"\.(tsx|jsx|js)$") & text.rlike(r"<[A-Za-z][\w.]*(\s[^<>]*)?/?>")),
        ("[USER_PRIVILEGE]", calls(CLIENT_ENTRIES)),
        ("[ELEVATED_PRIVILEGE]", text.rlike(r"(?<![\w.$])admin\s*\.\s*\w+")),
        ("[HOOK]", plain & name.rlike("^use[A-Z]")),
        ("[CONTEXT_PROVIDER]", text.rlike(r"<[A-Za-z_][A-Za-z0-9_.]*\.Provider\b")),
        ("[CONTEXT_CONSUMER]", text.rlike(r"\buseContext\s*\(")),
        ("[FIRESTORE_MUTATION]", text.rlike(MUTATION)),
        ("[SERVER_ACTION]", action),
        ("[FIREBASE_CALLABLE]", text.rlike(r"\bonCall\s*\(")),
        ("[FIRESTORE_TRIGGER]", text.rlike(r"\bon(?:Write|Create|Update|Delete)\s*\(")),
    )
    return F.concat(own, tag_symbol(name, text))


def csharp_symbol(name: Column, text: Column) -> Column:
    own = _tags(*((tag, text.rlike(rf"\[[^\]\n]*\b{a}\b")) for a, tag in ATTRIBUTES.items()))
    return F.concat(own, tag_symbol(name, text))


def cpp_symbol(name: Column, text: Column) -> Column:
    some = lambda names: F.exists(F.array(*(F.lit(f"{n}(") for n in names)), lambda n: text.contains(n))
    return F.concat(tag_symbol(name, text), _tags(("[CPP_UNSAFE_BUF]", some(UNSAFE_CALLS)), ("[CPP_EXEC_CMD]", some(EXEC_CALLS))))
