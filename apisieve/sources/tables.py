"""Reference tables that are part of the engine: modes of open(), purity of builtins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def open_modes() -> list[tuple[str, str]]:
    """What a mode string of open() does to the file: READ, WRITE or READ_WRITE."""
    out = []
    for letter in "rwax":
        for tail in ("", "b", "t", "+", "b+", "+b", "t+", "+t"):
            out.append((letter + tail, "READ_WRITE" if "+" in tail else "READ" if letter == "r" else "WRITE"))
    return out


_ALL = ("NonLocalVariableRead", "NonLocalVariableWrite", "FileRead", "FileWrite")
_PAIR = _ALL[:2]
#: Builtins that read or write something, with what.
EFFECTS = {
    **dict.fromkeys(("breakpoint", "compile", "eval", "exec"), _ALL),
    **dict.fromkeys(("delattr", "globals", "locals", "setattr", "vars"), _PAIR),
    **dict.fromkeys(("getattr", "hasattr"), _ALL[:1]),
    "input": ("FileRead",), "print": ("FileWrite",), "help": ("FileWrite",),
}


#: Builtins of Python (fixed values): exceptions, and functions, types and constants.
EXCEPTIONS = """
ArithmeticError AssertionError AttributeError BaseException BaseExceptionGroup BlockingIOError BrokenPipeError BufferError BytesWarning ChildProcessError ConnectionAbortedError ConnectionError
ConnectionRefusedError ConnectionResetError DeprecationWarning EOFError EncodingWarning EnvironmentError Exception ExceptionGroup FileExistsError FileNotFoundError FloatingPointError FutureWarning
GeneratorExit IOError ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError KeyboardInterrupt LookupError MemoryError ModuleNotFoundError NameError
NotADirectoryError NotImplementedError OSError OverflowError PendingDeprecationWarning PermissionError ProcessLookupError PythonFinalizationError RecursionError ReferenceError ResourceWarning
RuntimeError RuntimeWarning StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TabError TimeoutError TypeError UnboundLocalError UnicodeDecodeError UnicodeEncodeError
UnicodeError UnicodeTranslateError UnicodeWarning UserWarning ValueError Warning ZeroDivisionError
"""
BUILTINS = """
Ellipsis False None NotImplemented True abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter
float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord pow print property range repr
reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip
"""
#: Methods of str, bytes, list, dict, set, tuple, int and float (fixed values).
METHODS = """
add append as_integer_ratio bit_count bit_length capitalize casefold center clear conjugate copy count decode denominator difference difference_update discard encode endswith expandtabs extend find
format format_map from_bytes fromhex fromkeys get hex imag index insert intersection intersection_update is_integer isalnum isalpha isascii isdecimal isdigit isdisjoint isidentifier islower isnumeric
isprintable isspace issubset issuperset istitle isupper items join keys ljust lower lstrip maketrans numerator partition pop popitem real remove removeprefix removesuffix replace reverse rfind rindex
rjust rpartition rsplit rstrip setdefault sort split splitlines startswith strip swapcase symmetric_difference symmetric_difference_update title to_bytes translate union update upper values zfill
"""
#: Modules of Python's library that are not written in Python (fixed values).
NATIVE = "array atexit binascii builtins cmath errno faulthandler fcntl gc grp itertools marshal math mmap msvcrt posix pwd pyexpat resource select sys syslog termios time unicodedata winreg winsound xxsubtype zlib".split()


def builtin_purity() -> list[tuple[str, bool, list[str]]]:
    """(name, is_pure, reasons) of Python's builtins: exceptions, None and Ellipsis count as impure without a reason."""
    silent = {*EXCEPTIONS.split(), "None", "Ellipsis"}
    return [(name, name not in EFFECTS and name not in silent, list(EFFECTS.get(name, ()))) for name in sorted([*EXCEPTIONS.split(), *BUILTINS.split()])]


def method_names() -> list[str]:
    """Methods of builtin types, which count as pure where their object isn't known."""
    return METHODS.split()


#: Calls that are taken for file operations.
OPEN_LIKE = ("open", "read", "readline", "readlines", "write", "writelines", "close")


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows = {
        "open_modes": (open_modes, "mode string, effect string"),
        "builtin_purity": (builtin_purity, "name string, is_pure boolean, reasons array<string>"),
        "method_names": (lambda: [(n,) for n in method_names()], "name string"),
    }[name]
    return spark.createDataFrame(rows[0](), rows[1])
