from . import color, geometry, layers, sizes, text, web  # noqa: F401
