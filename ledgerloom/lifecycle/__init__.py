"""The event lifecycle: one pure step, used by batch and streaming."""
