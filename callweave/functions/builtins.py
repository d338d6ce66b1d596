"""Names that call resolution takes for built in."""

from __future__ import annotations

#: Prefixes of a callee that is built in.
PREFIXES = """
console. window. document. navigator. location. history. Math. JSON. Object. Array. Promise. Number. String. Boolean. RegExp. Date. Map. Set. WeakMap.
WeakSet. Symbol. Proxy. Reflect. Intl. Atomics. SharedArrayBuffer. ArrayBuffer. DataView. Float32Array. Float64Array. Int8Array. Int16Array.
Int32Array. Uint8Array. process. Buffer. global. globalThis. Error. TypeError. RangeError. SyntaxError. ReferenceError. URL. URLSearchParams. Headers.
Request. Response. TextEncoder. TextDecoder. AbortController. AbortSignal. FormData. Blob. File. FileReader. crypto. performance. queueMicrotask. fs.
path. os. util. http. https. net. dns. child_process. cluster. stream. zlib. events.
""".split()

#: Names of a callee, less a trailing exclamation mark, that is built in.
NAMES = """
setTimeout setInterval clearTimeout clearInterval requestAnimationFrame cancelAnimationFrame parseInt parseFloat isNaN isFinite encodeURI decodeURI
encodeURIComponent decodeURIComponent fetch atob btoa structuredClone eval alert confirm prompt require import super this Number String Boolean Array
Object Symbol BigInt Error TypeError RangeError SyntaxError setImmediate clearImmediate queueMicrotask println eprintln print eprint format write
writeln vec panic todo unimplemented unreachable assert assert_eq assert_ne debug_assert debug_assert_eq debug_assert_ne cfg env concat stringify
include_str include_bytes line column file module_path dbg matches Some None Ok Err to_string to_owned clone into from as_ref as_mut as_str as_bytes
unwrap unwrap_or unwrap_or_default unwrap_or_else expect is_empty is_some is_none is_ok is_err len push pop get insert remove contains iter map filter
collect and_then or_else ok_or ok_or_else flat_map for_each any all find position enumerate zip take skip chain join split trim starts_with ends_with
contains_key entry or_insert or_insert_with default
""".split()
