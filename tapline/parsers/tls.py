"""The server name a TLS client asks for."""

from __future__ import annotations

from tapline.parsers.cursor import Cursor, Short

# Record type handshake, message type client hello, extension server_name, name type host_name.
HANDSHAKE, CLIENT_HELLO, SERVER_NAME, HOST_NAME = 22, 1, 0, 0


def server_name(payload: bytes) -> str | None:
    """The first host name of a client hello that lies whole in one record; lower case, trimmed."""
    c = Cursor(payload)
    try:
        c.need(c.number(1) == HANDSHAKE)
        c.take(2)
        size = c.number(2)
        c.need(0 < size <= c.left())
        c.need(c.number(1) == CLIENT_HELLO)
        c.take(3 + 2 + 32)  # length, version, random
        for width in (1, 2, 1):  # session id, cipher suites, compression methods
            c.take(c.number(width))
        extensions = c.sub(c.number(2))
        while extensions.left() >= 4:
            kind, content = extensions.number(2), extensions.sub(extensions.number(2))
            if kind == SERVER_NAME:
                return _host(content)
    except Short:
        pass
    return None


def _host(content: Cursor) -> str | None:
    names = content.sub(content.number(2))
    while names.left() >= 3:
        kind, name = names.number(1), names.take(names.number(2))
        if kind == HOST_NAME:
            return name.decode("utf-8", "replace").strip().lower()
    return None
