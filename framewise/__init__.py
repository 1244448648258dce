"""Distributed analytics operators over shot, pose, motion and skeleton tables."""
