"""Planning of service calls, extraction, materialisation and mapping tools."""
