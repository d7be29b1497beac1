"""Tables, feed payloads and service responses as DataFrames."""
