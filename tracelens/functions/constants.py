"""Fixed values of the trace model: bands, classes, profiles, rules, magics."""

from __future__ import annotations

READ_OPS = ["ReadFile", "IRP_MJ_READ", "FastIORead"]
DECLINED = "FAST IO DISALLOWED"
BLOCK = 4096

# Fixed values: (least, greatest, name) of the length bands, both ends inclusive.
CHUNK_BANDS = [
    (1, 512, "<=512B"), (513, 1024, "513B-1K"), (1025, 2048, "1-2K"), (2049, 4096, "2-4K"), (4097, 8192, "4-8K"), (8193, 16384, "8-16K"), (16385, 32768, "16-32K"),
    (32769, 65536, "32-64K"), (65537, 131072, "64-128K"), (131073, 262144, "128-256K"), (262145, 524288, "256-512K"), (524289, 1048576, "512K-1M"), (1048577, 1 << 40, ">1M"),
]
LIBRARY_BANDS = [(0, 4096, "<=4K"), (4097, 8192, "4-8K"), (8193, 16384, "8-16K"), (16385, 65536, "16-64K"), (65537, 262144, "64-256K"), (262145, 524288, "256-512K"), (524289, 1 << 40, ">512K")]
SCRIPT_BANDS = [(0, 4096, "4K"), (4097, 8192, "8K"), (8193, 16384, "16K"), (16385, 131072, "128K"), (131073, 262144, "256K"), (262145, 524288, "512K"), (524289, 1 << 40, ">512K")]
SCAN_BANDS = [(0, 4096, "4K"), (4097, 8192, "8K"), (8193, 16384, "16K"), (16385, 262144, "256K"), (262145, 524288, "512K"), (524289, 1 << 40, ">512K")]
BAND_SYSTEMS = {"chunk": CHUNK_BANDS, "library": LIBRARY_BANDS, "script": SCRIPT_BANDS, "scan": SCAN_BANDS}

# Semantic classes of region names; other names are `section`.
REGION_CLASSES = {
    "headers": ["DOS Header", "DOS Stub", "NT Headers", "File Header", "Optional Header", "Section Table"],
    "directories": ["Import Directory", "Export Directory", "Resource Directory", "Relocation Directory", "TLS Directory", "Debug Directory", "Certificate Table", "Bound Import Directory", "Delay Import Directory", "IAT Directory", "COM Descriptor Directory"],
    "overlay": ["Overlay"],
    "code": [".text", ".itext", "PAGE", "PAGELK", "POOLCODE", "PAGEKD", "INIT"],
    "readonly": [".rdata", ".imrsiv"],
    "data": [".data", ".bss"],
    "imports": [".didat", ".idata"],
    "exports": [".edata"],
    "resources": [".rsrc"],
    "relocations": [".reloc"],
    "exceptions": [".pdata", ".xdata"],
    "tls": [".tls"],
    "protdata": ["PROTDATA"],
    "gfids": ["GFIDS"],
    "padding": ["Pad1"],
    "encrypt": ["?g_Encry"],
}
# The classes of a feature vector, in order.
VECTOR_CLASSES = ["headers", "directories", "code", "readonly", "data", "resources", "relocations", "exceptions", "tls", "overlay", "section", "padding", "encrypt"]

# Operations that a filter profile keeps, lower case; None keeps all.
PROFILES = {"minimal": ["createfile", "readfile"], "extended": ["createfile", "readfile", "queryinformationfile", "querystandardinformationfile", "closefile"], "full": None}

# The default phase rules (name, required regions, ordered optional regions, least reads).
PHASE_RULES = [
    ("Header Inspection", ["DOS Header", "NT Headers", "Section Table"], [], 1),
    ("Directory Parsing", ["Import Directory"], [], 1),
    ("Certificate Verification", ["Certificate Table"], [], 1),
    ("Resource Parsing", ["Resource Directory"], [], 1),
    ("Code Scanning", [".text"], [], 1),
    ("Overlay Inspection", ["Overlay"], [], 1),
    ("Relocation Processing", ["Relocation Directory"], [], 1),
]

# Leading bytes of file kinds, hexadecimal.
MAGICS = [("executable", "4D5A"), ("archive", "504B0304"), ("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("office", "D0CF11E0A1B11AE1")]

# Fixed values: (least, greatest, note) of the offsets that annotations name, both ends inclusive; the first that fits counts.
NOTE_RANGES = [
    (0x600, 0x5FFF, "early code probe"), (0xBB800, 0xCFFFF, "import region probe"), (0xF2A00, 0xF71FF, "TLS structure"), (0xF7200, 0xF7BFF, "resource section"), (0xF8600, 0xF9FFF, "relocation section"),
]
