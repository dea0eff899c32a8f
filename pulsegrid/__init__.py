"""pulsegrid: Spark jobs that search radio data for short dispersed pulses."""
